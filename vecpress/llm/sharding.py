"""Sharding by sampled splitters.

Keys are (hash of the text, hash of the doc_id and of the row). Records are drawn with a chance
in proportion to their size; quantiles of the drawn keys are the boundaries of many small
ranges, so that equal texts lie side by side and a text with more bytes than a range is cut
between its rows, be they alike or not. Each range is measured exactly; those that came out
overfull are subdivided by denser samples of their own until none is, or no boundary is left
that would part one. Ranges then go to shards, largest first to the emptiest shard. Ranges of
one text travel together as long as that leaves their shard within a range of the mean.

Law: bytes. Shards get nearly equal sizes (within about one range, or the largest record).

Defined cases: a null text has no bytes and the key of an empty one. Rows that repeat a key are
told apart by their place in the written table, which is all that tells them apart; null
doc_ids are an id like others. An empty table gives no rows. Extra columns are carried by
`shard`; one named like an output is replaced.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vecpress.llm.common import materialize

SHARDS = 8
#: Ranges for each shard, and samples for each range.
RANGES = 64
SAMPLES = 48
#: Records of a range at most, on average; large tables get more ranges.
ROWS = 2_000_000
#: Largest range that stays whole, in times the mean.
OVERFULL = 3.0

Bounds = tuple[np.ndarray, np.ndarray]


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
        "__key": F.xxhash64(text),
        # the id's hash, and below it as many bits of the row's as part a million like rows
        "__id": F.xxhash64("doc_id").bitwiseAND(F.lit(~((1 << 20) - 1))).bitwiseOR(F.xxhash64("__row", F.lit(5)).bitwiseAND(F.lit((1 << 20) - 1))),
    })


def _drawn(sized: DataFrame, per_byte: float) -> np.ndarray:
    """(n, 2) keys of a size-weighted sample, sorted; a record of weight w counts up to
    ceil(w * per_byte) times. The draw depends on the record and its row, not on the run."""
    u = (F.xxhash64("__key", "__row", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
    times = F.floor(F.col("size") * per_byte + u).cast("int")
    rows = sized.select("__key", "__id", times.alias("n")).where("n > 0").toArrow()
    key, doc, n = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((doc, key))
    return np.repeat(np.stack([key, doc], 1)[order], n[order], axis=0)


def _quantiles(drawn: np.ndarray, ranges: int) -> np.ndarray:
    """First keys of ranges 1, 2, ... of about equal sample counts. A boundary in the middle of
    a text's records moves to the text's start, unless the text alone fills a range."""
    if not len(drawn):
        return np.zeros((0, 2), np.int64)
    at = np.unique(np.linspace(0, len(drawn), ranges + 1).astype(int)[1:-1])
    cuts = []
    starts = np.searchsorted(drawn[:, 0], drawn[at, 0], "left")
    ends = np.searchsorted(drawn[:, 0], drawn[at, 0], "right")
    lowest = np.iinfo(np.int64).min
    for i, a, b in zip(at, starts, ends, strict=True):
        cuts.append((drawn[i, 0], lowest))
        if b - a > len(drawn) / ranges:
            cuts.append((drawn[i, 0], drawn[i, 1]))
            if b < len(drawn):
                cuts.append((drawn[b, 0], lowest))
    return np.array(sorted(set(map(tuple, cuts))), np.int64).reshape(-1, 2)


def _ranged(sized: DataFrame, bounds: np.ndarray) -> DataFrame:
    """sized with __range: how many bounds are at or below its key."""
    sent = sized.sparkSession.sparkContext.broadcast(bounds)
    names = sized.columns
    schema = StructType([*sized.schema, StructField("__range", IntegerType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            key = batch.column("__key").to_numpy(zero_copy_only=False)
            doc = batch.column("__id").to_numpy(zero_copy_only=False)
            low = np.searchsorted(cuts[:, 0], key, "left")
            high = np.searchsorted(cuts[:, 0], key, "right")
            out = high.astype(np.int32)
            for k in np.unique(key[low < high]):
                rows = np.flatnonzero(key == k)
                a, b = low[rows[0]], high[rows[0]]
                out[rows] = a + np.searchsorted(cuts[a:b, 1], doc[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "__range"])

    return sized.mapInArrow(search, schema)


def _measure(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    return {r[0]: (r[1], r[2]) for r in ranged.groupBy("__range").agg(F.sum("size"), F.count("*")).collect()}


def assign(sizes: dict[int, tuple[int, int]], bounds: np.ndarray, shards: int) -> dict[int, int]:
    """Shard of each range: units, largest first, to the emptiest shard. A unit is a range, or
    all ranges of one text unless they would take the shard over the mean by more than a range."""
    total, largest = sum(b for b, _ in sizes.values()), max((b for b, _ in sizes.values()), default=0)
    units: dict[tuple, list[int]] = defaultdict(list)
    for r in sizes:
        inside = r and bounds[r - 1, 1] != np.iinfo(np.int64).min  # begins within a text
        opens = r < len(bounds) and bounds[r, 1] != np.iinfo(np.int64).min
        units[("text", int(bounds[r - 1, 0])) if r and (inside or opens) else ("range", r)].append(r)
    loads = [(0, s) for s in range(shards)]
    waiting = [(-sum(sizes[r][0] for r in rs), key[1], rs) for key, rs in units.items()]
    heapq.heapify(waiting)
    out = {}
    while waiting:
        weight, key, rs = heapq.heappop(waiting)
        load, s = loads[0]
        if len(rs) > 1 and load - weight > total / shards + largest:
            for r in rs:  # too much for any shard: its ranges go one by one
                heapq.heappush(waiting, (-sizes[r][0], key, [r]))
            continue
        out.update(dict.fromkeys(rs, s))
        heapq.heapreplace(loads, (load - weight, s))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES, keep_text: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null under this law).

    slot numbers the records of a shard from 0 in order of range and key. Splitters come from
    keys and sizes alone. The records are written once, with a number of their row, as like
    rows must keep theirs from pass to pass. keep_text=False leaves the text out of that.
    """
    spark = docs.sparkSession
    outputs = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in outputs and (keep_text or c != "text")]
    source = docs.select(*[c for c in docs.columns if c not in outputs]).withColumn("__row", F.monotonically_increasing_id())
    whole = materialize(_sized(source).select(*kept, "size", "text_crc32", "__key", "__id", "__row"), "sized")
    sized = whole.select("size", "__key", "__id", "__row")
    rows, total = sized.agg(F.count("*"), F.sum("size")).head()
    total = total or 0
    wanted = shards * max(ranges, rows // (shards * ROWS))
    bounds = _quantiles(_drawn(sized, min(1.0, wanted * samples / max(total, 1))), wanted)
    sizes = _measure(_ranged(sized, bounds))
    while True:
        most = OVERFULL * total / wanted
        over = [r for r, (b, n) in sizes.items() if b > most and n > 1]
        if not over:
            break
        table = spark.createDataFrame([(r,) for r in over], "__r int")
        inner = _ranged(sized, bounds).join(F.broadcast(table), F.col("__range") == F.col("__r"), "left_semi")  # fewer than ranges
        heavy = sum(sizes[r][0] for r in over)
        parts = int(min(4 * wanted, 1 + 2 * heavy * wanted / total))
        more = _quantiles(_drawn(inner, min(1.0, 4 * parts * samples / heavy)), 2 * parts)
        merged = np.unique(np.concatenate([bounds, more]), axis=0)
        if len(merged) == len(bounds):
            break  # what is left are rows that no key parts
        bounds = merged
        sizes = _measure(_ranged(sized, bounds))
    to = assign(sizes, bounds, shards)
    first, used = {}, defaultdict(int)
    for r in sorted(sizes):
        first[r] = used[to[r]]
        used[to[r]] += sizes[r][1]
    table = spark.createDataFrame([(r, to[r], first[r]) for r in sorted(sizes)], "__r int, shard int, __first long")
    order = "row_number() over (partition by __range order by __key, __id, __row)"
    numbered = _ranged(whole, bounds).withColumn("__n", F.expr(order) - 1)
    numbered = numbered.join(F.broadcast(table), F.col("__range") == F.col("__r"))  # one row a range
    return numbered.select(
        *kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__n") + F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op1."""
    return shard(docs.select("doc_id", "text"), keep_text=False)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard. Its files hold runs of slots, each in order, and their names
    sort as their runs do; slots are dealt to tasks by range, so that no shard is one task."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
