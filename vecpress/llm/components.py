"""Connected components of a link table, by alternating star contractions on DataFrames.

Links stay distributed: each round is two grouped minima and two joins, and its result is
written to the shared folder; the round before is deleted then. Rounds grow with the logarithm
of the longest chain. A link is kept once, from its larger to its smaller node, so that a node
of many links is one key only where it is joined. Nodes with 1/HUBS of all links, at most HUBS by
arithmetic, are joined by broadcast for that; the others by sort-merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.llm.common import forget, materialize, shuffled

HUBS = 10_000
#: Nodes that a task holds of its links before it hands on what they tell.
HELD = 1_000_000

_PAIR = "u long, v long"


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task become (node, smallest node that the task links to it), HELD nodes at a time."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def forest() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if find(x) != x]
        for i in range(0, len(nodes), 65536):
            part = nodes[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])
        parent.clear()

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD:
            yield from forest()
    yield from forest()


def _least_of(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """edges, a written table, with the m that `least` (key, m) has for `key`, or null."""
    rows = edges.count()
    hubs = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HUBS >= rows).select(key, F.lit(True).alias("hub"))
    marked = edges.join(F.broadcast(hubs), key, "left")  # at most HUBS rows
    of_hubs = least.join(F.broadcast(hubs.select(key)), key, "left_semi")
    hot = marked.where("hub").join(F.broadcast(of_hubs), key, "left")
    cold = marked.where("hub is null").join(shuffled(least), key, "left")
    return hot.select("u", "v", "m").union(cold.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """links: two long columns. Returns (u, v): every linked node but the smallest of each
    component, with that smallest node. No links give no rows."""
    u, v = links.columns
    edges = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").mapInArrow(_local_forest, _PAIR)
    edges = materialize(edges, "links")
    seen = None
    while True:
        # Each node's larger neighbours go to the smallest of its neighbours and itself.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = _least_of(edges, "v", least.withColumnRenamed("u", "v")).select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = materialize(large, "large")
        # Each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _least_of(large, "u", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(least.select("u", F.col("m").alias("v")).union(moved).distinct(), "small")
        forget(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            return edges
        seen = now


def spanning_links(values: np.ndarray, linked) -> list[tuple[int, int]]:
    """A forest of the graph on distinct `values` whose links `linked(value, others)` tells.

    Breadth first over what is not reached yet: memory follows the values, not their pairs.
    """
    out, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = linked(x, rest)
            if near.any():
                hits, rest = rest[near], rest[~near]
                out += [(int(x), int(y)) for y in hits]
                queue.extend(hits)
    return out
