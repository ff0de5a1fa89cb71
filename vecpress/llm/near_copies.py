"""Near copies by the similarity of their sets of five-word shingles.

Two texts are linked if the Jaccard similarity of their sets is SIMILARITY or more; a group is
a component of the links. Candidates come from `simhash` first: the set's own fingerprint, by the
majority of its shingle hashes, the pigeonring index and filter over distinct fingerprints, and
their components. A component is a unit whose sets are then compared exactly. A fingerprint of 64
bits reaches no further than close copies: at 0.8 two of them differ in about ten bits, and a
distance that misses few of those lets unrelated texts through. For the rest, texts that share all
ROWS minima of any of BANDS bands are candidates too (a pair at 0.8 is missed with a chance of
1e-5). Each link, of either kind, is checked on the sets themselves.

Links are found between distinct sets, of which one text each is read. Keys with the same members
are one unit of work. A unit of at most BLOCK sets and UNIT_BYTES goes to one task, which gives a
spanning forest. A larger one is worked off in rounds: a strip of at most ACTIVE of its sets, and
STRIP bytes, those that have a link already first, stays in memory while all its other sets stream
past in as many tasks as their bytes ask for; the strip is then done, and a unit whose sets are all
linked to each other ends. A set that resembles one of a strip's linked sets is not held against
the others of them. No pair that could still join two groups is left out.

Words are those of `simhash`. A text of one to four words is one shingle; null and empty texts,
and those of white space, share the empty one. Texts may be of any length: a task holds the sets
of one unit within the bounds, or a strip and one more. Rows with a null doc_id link others and
stay; rows that repeat a doc_id are rows of their own. An empty table stays empty. Extra columns
are kept, whatever their names; those that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.llm import simhash
from vecpress.llm.common import forget, give_back, materialize, shuffled, small
from vecpress.llm.components import components, spanning_links
from vecpress.llm.decontamination import shingle_hashes
from vecpress.llm.lm_scoring import Hasher
from vecpress.llm.simhash import bit_counts, first_of_components, majority, named_fingerprints

WIDTH = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
#: Sets, and their bytes, of a unit that one task compares whole.
BLOCK = 2048
UNIT_BYTES = 16 << 20
#: Sets, and their bytes, that a task holds of a larger unit; bytes that stream past in one task.
ACTIVE = 1024
STRIP = 32 << 20
STREAM = 64 << 20
#: Words whose hashes a task remembers.
WORDS = 50_000
_ODD = np.random.default_rng(23).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(29).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingle_set(text: bytes | None, hasher: Hasher, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text."""
    words = (text or b"").lower().split()
    return np.unique(shingle_hashes(hasher(words), width)) if words else np.zeros(1, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its minima and its number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 2048):  # bounded memory for very long texts
        low = np.minimum(low, (own[i : i + 2048] * _ODD + _ADD).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def set_fingerprint(own: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes: bits that more than half of them have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(own), 65536):  # bounded memory for very long texts
        counts += bit_counts(own[i : i + 65536])
    return majority(counts, len(own))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, __t, fp, ring, bands): text hash, hash, fingerprint and band keys of the set of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(WORDS)
        for batch in batches:
            fps, rings, bands = [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), hasher, width)
                fps.append(xxhash.xxh64_intdigest(own.tobytes()))
                rings.append(set_fingerprint(own))
                bands.append(band_keys(own).tobytes())
            fps, rings = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, rings))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, rings, pa.array(bands, pa.binary())], names=["doc_id", "__t", "fp", "ring", "bands"])
        del hasher
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("__t"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, __t long, fp long, ring long, bands binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, key) of each set and band."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)), pa.array(keys)], names=["fp", "key"])


def _ring_members(ids: DataFrame) -> DataFrame:
    """(fp, key) of each set whose fingerprint is that of another set or within simhash's distance
    of one: the key is that of the component."""
    rings = materialize(ids.groupBy("fp").agg(F.any_value("ring").alias("ring")), "rings")
    held = materialize(rings.groupBy("ring").agg(F.count("*").alias("n")), "fingerprints")
    joined = components(simhash.links(held.select("ring"))).select(F.col("u").alias("ring"), F.col("v").alias("root"))
    roots = joined.select("ring", "root").union(joined.select("root", "root").distinct())
    alone = held.where("n > 1").select("ring").join(shuffled(roots.select("ring")), "ring", "left_anti").select("ring", F.col("ring").alias("root"))
    roots = materialize(roots.union(alone), "roots")
    return rings.join(small(roots), "ring").select("fp", F.xxhash64("root", F.lit(BANDS)).alias("key"))


def _compared_sets(docs: DataFrame, ids: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(fp, size, own): the sets of the members, and their bytes."""
    # copies share a set: one text of each is named before anything meets by it
    named = ids.groupBy("fp").agg(F.min("__t").alias("__t"))
    texts = materialize(named.join(shuffled(members.select("fp").distinct()), "fp"), "compared")
    own = docs.select(F.xxhash64("text").alias("__t"), F.col("text").cast("binary").alias("text"))
    texts = own.join(small(texts), "__t").groupBy("fp").agg(F.any_value("text").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(WORDS)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [shingle_set(t.as_py(), hasher, width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["fp", "size", "own"])
        del hasher
        give_back()

    return materialize(texts.mapInArrow(compute, "fp long, size long, own binary"), "compared-sets")


def _forests(similarity: float):
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for unit in batch.column(0):
                rows = sorted({r["fp"].as_py(): r["own"].as_py() for r in unit.values}.items())
                sets = [np.frombuffer(x, np.uint64) for _, x in rows]

                def near(i: int, others: np.ndarray, sets: list = sets) -> np.ndarray:
                    return np.fromiter((similar(sets[i], sets[j], similarity) for j in others), bool, len(others))

                found += [(rows[i][0], rows[j][0]) for i, j in spanning_links(np.arange(len(rows)), near)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return forests


class _Strip:
    """Sets that stay while others stream past, in groups that are known to be linked."""

    def __init__(self, fps: list[int], labels: list[int], sets: list[np.ndarray], similarity: float):
        self.fps, self.sets, self.similarity = fps, sets, similarity
        self.groups: list[tuple[list[int], set[int]]] = []  # numbers of sets, labels
        self.links: list[tuple[int, int]] = []
        for i, label in enumerate(labels):
            own, labels_of = [i], {label}
            for hit in self._met(sets[i], label):
                numbers, known = self.groups[hit[0]]
                own, labels_of = numbers + own, known | labels_of
                if hit[1] is not None:
                    self.links.append((fps[i], fps[hit[1]]))
            self.groups = [g for g in self.groups if not g[0][0] in set(own)] + [(own, labels_of)]

    def _met(self, one: np.ndarray, label: int) -> list[tuple[int, int | None]]:
        """(group, set of it that resembles this one); None: its label says that they are linked."""
        out: list[tuple[int, int | None]] = []
        for g, (numbers, known) in enumerate(self.groups):
            if label in known:
                out.append((g, None))
                continue
            hit = next((j for j in numbers if similar(one, self.sets[j], self.similarity)), None)
            if hit is not None:
                out.append((g, hit))
        return out

    def meet(self, fp: int, label: int, one: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        """The set's label from now on, and its links to the strip."""
        met = self._met(one, label)
        links = [(fp, self.fps[j]) for _, j in met if j is not None]
        return (min(min(self.groups[g][1]) for g, _ in met) if met else label), links


_STATE = "key long, fp long, label long, hit int, size long"


def _rounds(units: DataFrame, sets: DataFrame, similarity: float) -> list[DataFrame]:
    """(u, v) tables of links of units (key, fp, size) that are too large for a task."""
    state = materialize(units.select("key", "fp", F.col("fp").alias("label"), F.lit(0).alias("hit"), "size"), "state")
    found: list[DataFrame] = []

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, strip = None, [], None
        for whole in batches:
            for i in range(0, whole.num_rows, 16):
                out: list[tuple] = []
                for key, salt, kind, fp, label, hit, size, own in zip(*(c.to_pylist() for c in whole.slice(i, 16).columns), strict=True):
                    if (key, salt) != now:
                        now, held, strip = (key, salt), [], None
                    one = np.frombuffer(own, np.uint64)
                    if kind == 0:
                        held.append((fp, label, one))
                        continue
                    if kind == 1 and strip is None:  # the mark that ends a strip
                        strip = _Strip(*map(list, zip(*held, strict=True)), similarity)
                        out += [(None, None, None, None, None, *pair) for pair in strip.links if salt == 0]
                    if kind == 2:
                        label, pairs = strip.meet(fp, label, one)
                        out.append((key, fp, label, int(hit or bool(pairs)), size, None, None))
                        out += [(None, None, None, None, None, *pair) for pair in pairs]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "fp", "label", "hit", "size", "u", "v"])
        held, strip = [], None
        give_back()

    while True:
        # a unit is open while its sets have more than one label
        open_units = state.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
        open_units = materialize(open_units.select("key", F.ceil(F.col("bytes") / STREAM).cast("int").alias("tasks")), "open")
        if open_units.isEmpty():
            forget(open_units, state)
            return found
        rows = state.join(small(open_units), "key")
        order = Window.partitionBy("key").orderBy(F.desc("hit"), "fp")
        first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ACTIVE)
        first = first.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        first = materialize(first.where((F.col("r") == 1) | (F.col("sum") <= STRIP)).select("key", "fp", "label", "hit", "size", "tasks"), "strips")
        salts = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt")
        strips = first.select("key", salts, F.lit(0).alias("kind"), "fp", "label", "hit", "size")
        others = rows.join(shuffled(first.select("key", "fp")), ["key", "fp"], "left_anti")
        others = others.select("key", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("tasks")).cast("int").alias("salt"), F.lit(2).alias("kind"), "fp", "label", "hit", "size")
        both = strips.union(others).join(shuffled(sets.select("fp", "own")), "fp").select("key", "salt", "kind", "fp", "label", "hit", "size", "own")
        nothing = F.lit(None).cast("long")
        marks = open_units.select("key", salts, F.lit(1).alias("kind"), nothing.alias("fp"), nothing.alias("label"), F.lit(None).cast("int").alias("hit"), nothing.alias("size"), F.lit(b"").alias("own"))
        met = both.union(marks).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind", "fp")
        met = materialize(met.mapInArrow(stream, f"{_STATE}, u long, v long"), "met")
        found.append(met.where("u is not null").select("u", "v"))
        before, state = state, materialize(met.where("key is not null").select("key", "fp", "label", "hit", "size"), "state")
        forget(before, open_units, first)


def links(docs: DataFrame, ids: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) links between the distinct sets of docs, ids being their `_sets`."""
    members = ids.groupBy("fp").agg(F.any_value("bands").alias("bands")).mapInArrow(_members, "fp long, key long")
    members = materialize(members.union(_ring_members(ids)), "members")
    sums = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    shared = members.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    units = materialize(shared.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key", "n"), "units")
    members = materialize(members.join(small(units), "key").select("key", "fp"), "candidates")
    sets = _compared_sets(docs, ids, members, width)
    sized = materialize(members.join(shuffled(sets.select("fp", "size")), "fp"), "sized")
    held = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    held = materialize(held.select("key", ((F.col("n") <= BLOCK) & (F.col("bytes") <= UNIT_BYTES)).alias("whole")), "unit-sizes")
    sized = sized.join(small(held), "key")
    whole = sized.where("whole").join(shuffled(sets.select("fp", "own")), "fp").groupBy("key").agg(F.collect_list(F.struct("fp", "own")).alias("rows"))
    out = whole.select("rows").mapInArrow(_forests(similarity), "u long, v long")
    if not held.where("not whole").isEmpty():
        for found in _rounds(sized.where("not whole"), sets, similarity):
            out = out.union(found)
    return out


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, as `simhash.keep_first`."""
    ids = materialize(_sets(docs, width), "sets")
    named = named_fingerprints(ids, lambda distinct: links(docs, ids, width, similarity))
    return first_of_components(docs, ids.drop("ring", "bands"), named)
