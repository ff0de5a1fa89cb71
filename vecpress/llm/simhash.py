"""SimHash near-duplicates with a pigeonring filter.

A fingerprint has four 16-bit segments on a ring. If two fingerprints differ in at most t = 3
bits, there is a segment from which every chain of l consecutive segments differs in at most
l*t/4 bits (pigeonring principle): 0, 1, 2, 3 for l = 1 to 4. The first two steps of a chain
are an index: equal first segment, at most one differing bit in the second. Of the two
fingerprints of such a pair one can be turned into the other's key by setting one bit, so each
fingerprint probes its own key and those with one more bit set. The later steps of the chain
prune candidates before the full Hamming check.

Links are found between distinct fingerprints, never between documents; a key that many
fingerprints share is cut into blocks that meet pairwise, and each block pair gives the links
of a spanning forest rather than all its pairs.

Defined cases: an empty table gives no rows; texts of any length are read whole, in parts of
bounded memory. A null or empty text, or one of white space, has fingerprint zero. A null
doc_id takes part but names no component; a component of null ids alone has a null id. Rows
that repeat a doc_id or a text are linked as any others. Extra columns are kept by `link`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecpress.llm.common import materialize, small
from vecpress.llm.components import components, spanning_links

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
BITS = 64 // SEGMENTS
#: Fingerprints of one key that one task compares; a larger key is cut into blocks.
BLOCK = 4096
_MASK = np.uint64((1 << BITS) - 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.uint32).astype(np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes from their bit counts."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    ends = (ends - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for i in range(0, n, 65536):  # bounded memory for very long texts
        j = min(n, i + 65536)
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[i:j], ends[i + width - 1 : j + width - 1], strict=True)], np.uint64)
        counts += bit_counts(h)
    return majority(counts, n)


def with_fingerprint(docs: DataFrame, keep: list[str], width: int = SHINGLE) -> DataFrame:
    """The columns `keep` of docs, and fp: the bits of the text's fingerprint as a long."""
    schema = StructType([*(docs.schema[c] for c in keep), StructField("fp", LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            fps = [fingerprint(t.as_py(), width) for t in texts]
            column = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(compute, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, base): for each segment its key, and the keys with one more bit set next to it."""
    for whole in batches:
        for i in range(0, whole.num_rows, 8192):
            fp = whole.column(0).slice(i, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, fps, base = [], [], []
            for s in range(SEGMENTS):
                first = (fp >> np.uint64(BITS * s)) & _MASK
                second = (fp >> np.uint64(BITS * ((s + 1) % SEGMENTS))) & _MASK
                own = (np.uint64(s) << np.uint64(2 * BITS)) | (first << np.uint64(BITS)) | second
                keys.append(own)
                fps.append(fp)
                base.append(np.ones(len(fp), bool))
                for b in range(BITS):
                    unset = (second >> np.uint64(b)) & np.uint64(1) == 0
                    keys.append(own[unset] | np.uint64(1 << b))
                    fps.append(fp[unset])
                    base.append(np.zeros(int(unset.sum()), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(base))], names=["key", "fp", "base"])


def chain_ok(x: np.uint64, others: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which of others have a segment all of whose chains with x stay within their budgets."""
    diff = x ^ others
    parts = np.stack([np.bitwise_count((diff >> np.uint64(BITS * s)) & _MASK) for s in range(SEGMENTS)])
    found = np.zeros(len(others), bool)
    for s in range(SEGMENTS):
        total, good = np.zeros(len(others), np.int64), np.ones(len(others), bool)
        for step in range(SEGMENTS):
            total = total + parts[(s + step) % SEGMENTS]
            good &= total * SEGMENTS <= (step + 1) * distance
        found |= good
    return found


def near(x: np.uint64, others: np.ndarray) -> np.ndarray:
    """Pigeonring filter, then the full check."""
    out = chain_ok(x, others)
    out[out] = np.bitwise_count(x ^ others[out]) <= DISTANCE
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links: list[tuple[int, int]] = []
        for fps in batch.column(0):
            values = np.unique(np.array(fps.as_py(), np.int64).view(np.uint64))
            links += spanning_links(values, near)
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """distinct: one long column of distinct fingerprints. (u, v) links that connect whatever
    is within DISTANCE bits, without listing all pairs of a crowded key."""
    rows = materialize(distinct.mapInArrow(_keys, "key long, fp long, base boolean"), "key-rows")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("base").alias("any")).where("n > 1 and any")
    shared = materialize(shared.select("key", "n"), "keys")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = rows.join(small(shared), "key").select("key", "fp", blocks.alias("k"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    units = members.groupBy("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    return units.agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forests, "u long, v long")


def named_fingerprints(ids: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """ids: doc_id, fp. Returns (fp, component_id) of each distinct fingerprint; `linked` gives
    the links between distinct fingerprints."""
    least = materialize(ids.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    joined = components(linked(least.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("r"))
    rooted = materialize(least.join(joined, "fp", "left").select("fp", "first", F.coalesce("r", "fp").alias("root")), "rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    return materialize(rooted.join(names, "root").select("fp", "component_id"), "named")


def _finish(ids: DataFrame, kept: list[str]) -> DataFrame:
    named = named_fingerprints(ids)
    return ids.join(named, "fp").select(*kept, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def link(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    own = {c: f"__own_{c}" if c == "fp" else c for c in docs.columns if c not in ("fingerprint", "component_id")}
    renamed = docs.withColumnsRenamed({c: n for c, n in own.items() if c != n})
    out = _finish(materialize(with_fingerprint(renamed, list(own.values()), width), "fingerprints"), list(own.values()))
    return out.withColumnsRenamed({n: c for c, n in own.items() if c != n})


def keep_first(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each component: the row with the smallest doc_id; of rows that repeat
    it, the one with the smallest text hash, once. Rows with a null doc_id all stay."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__t"))
    ids = materialize(with_fingerprint(texts, ["doc_id", "__t"], width), "fingerprints")
    return first_of_components(docs, ids, named_fingerprints(ids))


def first_of_components(docs: DataFrame, ids: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs that keep_first keeps. ids: doc_id, __t (text hash), fp of each row."""
    first = ids.join(named, "fp").where("doc_id = component_id")
    first = materialize(first.groupBy(F.col("doc_id").alias("__id")).agg(F.min("__t").alias("__k"), F.count("*").alias("__n")), "first")
    rows = docs.join(first, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__k")))
    out = rows.where("__n = 1").select(*docs.columns)
    if not first.where("__n > 1").isEmpty():
        out = out.union(rows.where("__n > 1").dropDuplicates(["__id"]).select(*docs.columns))
    return out.union(docs.where("doc_id is null"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op8: doc_id, fingerprint, component_id."""
    ids = materialize(with_fingerprint(docs, ["doc_id"]), "fingerprints")
    return _finish(ids, ["doc_id"])
