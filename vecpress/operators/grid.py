"""Queries against rows as a grid of strips.

A strip of queries stays in a task's memory while a strip of rows streams past it, and keeps the
best of each query; the partial results of all strips of rows meet by query afterwards. Queries
that fit one strip, by measure, go to every task as they are and the rows stay where they are: one
scan, no shuffle of rows. Beyond that both sides are dealt to the cells of the grid, each query
once for each strip of rows and each row once for each strip of queries, and a cell's rows arrive
sorted behind its queries. With cells of an index a query meets only the cells it probes, and each
cell is a grid of its own, cut by its numbers of rows and queries, so that a hot cell is spread.
A caller's own bound on the queries that meet rows at a time cuts the strip inside the task (the
fold's tiles): it never makes more copies of the rows.

Memory of a task is a strip of queries with its results and one batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.functions.arrays import ROWS, to_matrix

#: Bytes of queries, and queries, of one strip.
QUERY_BYTES = 64 << 20
QUERY_ROWS = 16_384
#: Cells of the grid for each shuffle partition.
CELLS_PER_TASK = 2


class Fold(Protocol):
    """What a strip of queries keeps of the rows that it has met. tile: queries that meet a batch
    of rows at a time, at most."""

    tile: int

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        """Rows of one cell (0 without cells) meet the queries number `to`."""

    def out(self) -> Iterator[pa.RecordBatch]: ...


#: From ids (n) and vectors (n, dims) of queries.
MakeFold = Callable[[np.ndarray, np.ndarray], Fold]


def measure(queries: DataFrame) -> tuple[int, int]:
    """Queries, and bytes of their vectors."""
    n, held = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).head()
    return n, 8 * held


def queries_a_strip(n: int, size: int) -> int:
    """How many of n queries of so many bytes a strip takes within both bounds. Beyond one strip
    they are dealt by hash, so an eighth is left free."""
    most = min(QUERY_ROWS, QUERY_BYTES * n // size if size else n)
    return most if n <= most else max(1, most * 7 // 8)


def match(rows: DataFrame, queries: DataFrame, make: MakeFold, schema: str, probe: Callable[[np.ndarray], np.ndarray] | None = None, strip: int | None = None, key: str = "vec_id") -> DataFrame:
    """rows: columns that the fold reads, with `cell` if `probe` gives the cells of queries (n, c);
    queries: qid, q; strip: queries that meet rows at a time, at most; key: what rows are dealt by. Returns what the folds put out: partial
    results, several for each query. No queries give none."""
    n, size = measure(queries)
    if n == 0:
        return rows.sparkSession.createDataFrame([], schema)
    each = queries_a_strip(n, size)

    def tiled(names: np.ndarray, q: np.ndarray) -> Fold:
        fold = make(names, q)
        fold.tile = min(fold.tile, strip or fold.tile)
        return fold

    if n <= each:
        return _one_strip(rows, queries, tiled, schema, probe)
    return _many_strips(rows, queries, tiled, schema, probe, n, each, key)


def _one_strip(rows: DataFrame, queries: DataFrame, make: MakeFold, schema: str, probe) -> DataFrame:
    held = queries.select("qid", "q").toArrow()  # at most QUERY_ROWS and QUERY_BYTES
    ids, q = held["qid"].to_numpy().astype(np.int64), to_matrix(held["q"])
    by_cell = None
    if probe is not None:
        cells = probe(q)
        order = np.argsort(cells.ravel(), kind="stable")
        names, first = np.unique(cells.ravel()[order], return_index=True)
        by_cell = dict(zip(names.tolist(), np.split(order // cells.shape[1], first[1:]), strict=True))
        rows = rows.where(F.col("cell").isin(list(by_cell)))
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, by_cell))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = sent.value
        fold, every = make(ids, q), np.arange(len(ids))
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                if by_cell is None:
                    fold.add(batch, every, 0)
                    continue
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell):
                    if int(c) in by_cell:
                        fold.add(batch.take(pa.array(np.flatnonzero(cell == c))), by_cell[int(c)], int(c))
        yield from fold.out()

    return rows.mapInArrow(scan, schema)


def _many_strips(rows: DataFrame, queries: DataFrame, make: MakeFold, schema: str, probe, n: int, each: int, row_key: str) -> DataFrame:
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    columns = rows.columns
    if probe is None:
        across = -(-n // each)
        shape = {"__a": F.lit(across), "__b": F.lit(max(1, -(-tasks * CELLS_PER_TASK // across)))}
        rows, queries = rows.withColumn("__cell", F.lit(0)), queries.withColumn("__cell", F.lit(0))
        rows, queries = rows.withColumns(shape), queries.withColumns(shape)
    else:
        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    cells = probe(to_matrix(part.column("q")))
                    at = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(at), part.column("q").take(at), pa.array(cells.ravel().astype(np.int32))], names=["qid", "q", "__cell"])

        queries = queries.select("qid", "q").mapInArrow(probed, "qid long, q array<double>, __cell int")
        rows = rows.withColumn("__cell", F.col("cell"))
        # one row a cell, and an index has at most 65,536 cells
        held = rows.groupBy("__cell").agg(F.count("*").alias("n"))
        asked = queries.groupBy("__cell").agg(F.count("*").alias("m"))
        total = max(rows.count(), 1)
        across = F.ceil(F.col("m") / each).cast("int")
        along = F.greatest(F.lit(1), F.ceil(F.col("n") * tasks * CELLS_PER_TASK / total / across)).cast("int")
        shape = F.broadcast(asked.join(held, "__cell").select("__cell", across.alias("__a"), along.alias("__b")))
        rows, queries = rows.join(shape, "__cell"), queries.join(shape, "__cell")
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    deal = lambda key, k: F.pmod(F.xxhash64(key, F.lit(17)), F.col(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = queries.select("__cell", deal("qid", "__a").alias("__i"), all_of("__b").alias("__j"), F.lit(0).alias("__side"), F.col("qid").cast("long").alias("__qid"), F.col("q").alias("__q"), *blank)
    right = rows.select("__cell", all_of("__a").alias("__i"), deal(row_key, "__b").alias("__j"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__qid"), F.lit(None).cast("array<double>").alias("__q"), *columns)
    key = ["__cell", "__i", "__j"]
    dealt = left.union(right).repartition(tasks * CELLS_PER_TASK, *key).sortWithinPartitions(*key, "__side")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, q, fold, every = None, [], [], None, None
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                at = np.stack([batch.column(c).to_numpy() for c in (*key, "__side")], axis=1)
                cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    here, part = tuple(at[a, :3]), batch.slice(a, b - a)
                    if here != now:
                        if fold is not None:
                            yield from fold.out()
                        now, ids, q, fold = here, [], [], None
                    if at[a, 3] == 0:
                        ids.append(part.column("__qid").to_numpy())
                        q.append(to_matrix(part.column("__q")))
                    elif ids:
                        if fold is None:
                            fold, every = make(np.concatenate(ids).astype(np.int64), np.concatenate(q)), np.arange(sum(map(len, ids)))
                        fold.add(part.select(columns), every, int(here[0]))
        if fold is not None:
            yield from fold.out()

    return dealt.mapInArrow(cells, schema)
