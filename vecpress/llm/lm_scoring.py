"""Language-model scores by stupid backoff over word bigrams.

The corpus is its own training text. A word w after v scores c(vw)/c(v) if the pair occurs at
least MIN_COUNT times in all documents, and else ALPHA c(w)/N; the first word of a text scores
c(w)/N. A document's score is the sum of the logarithms. Counts are over all documents. With
MIN_COUNT 1 every pair that occurs has a count, so a corpus that is scored by its own tables
never backs off; higher values prune the bigram table.

The scores are relational. Words are counted into a table (word, count). Bigrams are exploded
to rows (first word, second word, document), dealt by the hash of the first word and joined
there with its count; the same partition counts the rows of each pair; each row's logarithm is
summed by document. Pairs below MIN_COUNT are joined with the counts of their second words. For
the way to their partition, the bigrams of one first word in one batch of texts travel as one
row, an array of second words beside one of documents, and are exploded on arrival: that is
what keeps the shuffle near the size of the texts.

Frequent keys are spread. Counts of words above 1/HOT of the corpus (at most HOT words, by
arithmetic) are broadcast; the rows of such a first word are dealt by (first word, bucket of the
second) into as many buckets as its count asks for. Frequent pairs (at most PAIRS, proposed by a
sample of documents that decides nothing but this) are counted exactly with the words and
scored where they stand. Partitions hold about PARTITION words; sorts and counts in them spill.

Words: runs without `[\\x20\\x09-\\x0D]`, A-Z lower-cased. Words are told apart by 64-bit
hashes, pairs by 64-bit hashes of both: of 10**10 distinct words a few would share one.

Defined cases: an empty table gives no rows; a null doc_id is kept. A null or empty text, or one of white space, has no words and score 0 (mean
null). Repeated rows count and are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.llm.common import forget, materialize, shuffle_partitions

ALPHA = 0.4
MIN_COUNT = 1
#: Words with at least 1/HOT of all words are frequent; so are pairs with 1/PAIRS of a sample.
HOT = 120_000
PAIRS = 100_000
#: Documents whose pairs look for frequent ones, about.
SAMPLED = 10_000
#: Bytes of text that travel as one batch; words of the corpus for each partition, and partitions at most.
BATCH = 2 << 20
PARTITION = 6_000_000
PARTS = 100_000

#: Stands for the word before the first one.
START = np.uint64(0)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY
    return x ^ (x >> np.uint64(29))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) + second)


class Hasher:
    """64-bit hashes of words, remembered; never 0."""

    def __init__(self, most: int = 80_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) or 1
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


Table = tuple[np.ndarray, np.ndarray]


def _lookup(table: Table, keys: np.ndarray) -> np.ndarray:
    """Counts of keys in a sorted table, 0 where it has none."""
    names, values = table
    if not len(names):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], 0)


class Sparse:
    """A sorted table that most keys are not in: a bit table turns those away first."""

    def __init__(self, table: Table, bits: int = 1 << 22):
        self.table, self.mask = table, np.uint64(bits - 1)
        self.marked = np.zeros(bits, bool)
        self.marked[table[0] & self.mask] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(self.marked[keys & self.mask])
        out[at] = _lookup(self.table, keys[at])
        return out


class Vocabulary:
    """Words as numbers within a task. A word's hash is taken when it is first met, and looked up
    among the frequent words: `hot` is its count there, or 0, `code` its place from 1, or the
    hash. Hashes are never so small. Beyond `most` words `full` says so and `clear` starts again."""

    def __init__(self, counts: Table, most: int = 80_000):
        self.counts, self.most = counts, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes, self.hot, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    @property
    def full(self) -> bool:
        return len(self.known) > self.most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        before = len(self.known)
        out = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))  # numbers new words as they come
        hashes = np.array([xxhash.xxh64_intdigest(w) | 1 << 62 for w in islice(self.known, before, None)], np.uint64)
        names, counts = self.counts
        at = _lookup((names, np.arange(1, len(names) + 1)), hashes)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.hot = np.concatenate([self.hot, np.append(0, counts)[at]])
        self.code = np.concatenate([self.code, np.where(at > 0, at.astype(np.uint64), hashes)])
        return out


def _batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, words of each, all words' numbers) of about BATCH bytes of text at a time. A
    longer text is one batch. Numbers hold until the next batch."""
    ids, counts, words, size = [], [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = (text.as_py() or b"").lower().split()
            ids.append(i)
            counts.append(len(own))
            words += own
            size += len(own) * 6
            if size >= BATCH or len(ids) == 32_000:
                yield ids, np.array(counts, np.int64), vocabulary(words)
                ids, counts, words, size = [], [], [], 0
    if ids:
        yield ids, np.array(counts, np.int64), vocabulary(words)


def _starts(counts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are the first of their document."""
    out = np.zeros(n, bool)
    out[(np.cumsum(counts) - counts)[counts > 0]] = True
    return out


def _all_pairs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of all bigrams within documents, without the first words."""
    return _pair(words[:-1], words[1:])[~_starts(counts, len(words))[1:]] if len(words) else words


def _sorted(rows: list) -> Table:
    names = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r[1] for r in rows], np.int64)[order]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 65536):
        part = slice(i, i + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=["kind", "key", "n"])


def _tally(texts: DataFrame, pairs: np.ndarray | None = None) -> DataFrame:
    """(kind, key, n): words (0), and those of the sorted `pairs` (1), or all pairs if that is None.
    A task sums its words before it sends them."""
    sent = texts.sparkSession.sparkContext.broadcast(pairs)
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, vocabulary, seen = sent.value, Vocabulary(nothing), np.zeros(0, np.int64)
        if pairs is not None:
            place, found = Sparse((pairs, np.arange(1, len(pairs) + 1))), np.zeros(len(pairs) + 1, np.int64)
        for _, counts, words in _batches(batches, vocabulary):
            own = np.bincount(words, minlength=len(vocabulary.hashes))
            own[: len(seen)] += seen
            seen = own
            both = _all_pairs(counts, vocabulary.hashes[words])
            if pairs is None:
                yield from _rows(1, *np.unique(both, return_counts=True))
            else:
                found += np.bincount(place(both), minlength=len(found))
            if vocabulary.full:
                yield from _rows(0, vocabulary.hashes, seen)
                vocabulary.clear()
                seen = np.zeros(0, np.int64)
        yield from _rows(0, vocabulary.hashes, seen)
        if pairs is not None:
            yield from _rows(1, pairs[found[1:] > 0], found[1:][found[1:] > 0])

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _frequent(texts: DataFrame) -> np.ndarray:
    """Pairs that a sample finds frequent, sorted: at most PAIRS."""
    share = SAMPLED / max(texts.count(), 1)
    drawn = texts.where(F.rand(5) < share) if share < 1 else texts
    pairs = materialize(_tally(drawn).where("kind = 1"), "sampled")
    total = pairs.agg(F.sum("n")).head()[0] or 0
    found = pairs.where((F.col("n") * PAIRS >= total) & (F.col("n") > 3)).select("key").collect()
    forget(pairs)
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def count_words(docs: DataFrame) -> DataFrame:
    """(word hash, n) of all words of docs (doc_id, text)."""
    return _tally(_texts(docs), np.zeros(0, np.uint64)).where("kind = 0").select(F.col("key").alias("word"), "n")


_SENT = "k long, c1 double, base long, words array<long>, docs array<short>"
_NAMES = ["k", "c1", "base", "words", "docs"]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _nested(hot: Table, pairs: Table, total: int, parts: int, min_count: int) -> Callable:
    """The map from texts to _SENT rows, of three kinds. Bigrams: k is the first word, or one of
    its buckets, which then come with the logarithm c1 of its count; words are the codes of those
    that follow in one batch, docs their documents, by place from base. Documents that begin with
    the word k: words holds START for each of docs. A document: k is its number, c1 what was scored
    on the spot, base its id, words its number of words, and docs is null."""
    log_total = math.log(max(total, 1))
    split = max(1, total // parts // 8)  # of a partition, so much may be one key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, vocabulary, pair_count = TaskContext.get().partitionId() << 33, Vocabulary(hot), Sparse(pairs)

        def rows(key: np.ndarray, after: np.ndarray, doc: np.ndarray, c1: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(key)
            key, after, doc, c1 = key[order], after[order], doc[order], c1[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            cuts = np.append(edge, len(key))
            for i in range(0, len(edge), 8192):
                at, ends = edge[i : i + 8192], cuts[i : i + 8193]
                a, b = ends[0], ends[-1]
                logs = pa.array(np.log(np.maximum(c1[at], 1)), mask=c1[at] == 0)
                lists = [_lists(after[a:b].view(np.int64), ends - a), _lists(doc[a:b], ends - a)]
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), logs, pa.array(np.full(len(at), base)), *lists], names=_NAMES)

        for ids, counts, numbers in _batches(batches, vocabulary):
            words, known, code = vocabulary.hashes[numbers], vocabulary.hot[numbers], vocabulary.code[numbers]
            doc = np.repeat(np.arange(len(ids), dtype=np.int16), counts)
            first = _starts(counts, len(words))
            before, c1 = np.roll(words, 1), np.roll(known, 1)  # 0 where the count is not at hand
            c = np.zeros(len(words), np.int64)
            ask = np.flatnonzero((c1 > 0) & ~first)
            c[ask] = pair_count(_pair(before[ask], words[ask]))
            here, begins = (c >= min_count) & (c > 0), first & (known > 0)
            own = np.zeros(len(ids))
            own += np.bincount(doc[here], np.log(c[here]) - np.log(c1[here]), len(ids))
            own += np.bincount(doc[begins], np.log(known[begins]) - log_total, len(ids))
            n = len(ids)
            columns = [pa.array(base + np.arange(n)), pa.array(own), pa.array(ids, pa.int64()), _lists(counts, np.arange(n + 1)), pa.nulls(n).cast(pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            cold = first & ~begins
            yield from rows(words[cold], np.full(cold.sum(), START), doc[cold], np.zeros(cold.sum(), np.int64))
            sent = ~here & ~first
            key, after, c1, doc = before[sent], code[sent], c1[sent], doc[sent]
            wide = np.flatnonzero(c1 >= split)  # first words that are more than a key should hold
            key[wide] = _pair(key[wide], _mix(after[wide]) % (1 + c1[wide] // split).astype(np.uint64))
            del words, known, code, before, c, ask, here, first, sent, numbers
            yield from rows(key, after, doc, np.where(c1 >= split, c1, 0))
            base += n
            if vocabulary.full:
                vocabulary.clear()

    return run


def score(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of each row of docs (doc_id, text).

    docs is read three times: pass a table, not a computation whose rows change their order.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    tally = materialize(_tally(texts, _frequent(texts)), "counts")
    total = tally.where("kind = 0").agg(F.sum("n")).head()[0] or 0
    hot = _sorted(tally.where((F.col("kind") == 0) & (F.col("n") * HOT >= total)).select("key", "n").collect())
    pairs = _sorted(tally.where("kind = 1").select("key", "n").collect())  # at most PAIRS
    parts = min(PARTS, max(shuffle_partitions(spark), -(-total // PARTITION)))
    known = spark.sparkContext.broadcast((hot, pairs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nested(*known.value, total, parts, min_count)(batches)

    words = tally.where("kind = 0").select(F.col("key").alias("word"), F.log("n").alias("log_n"))
    nested = texts.mapInArrow(send, _SENT).repartition(parts, "k")
    # The rows of documents go along, as a filter would run the map once for each kind.
    met = nested.join(words.hint("shuffle_hash"), F.col("k") == F.col("word"), "left")
    met = met.select("k", "base", F.coalesce("c1", "log_n").alias("x"), "docs", F.posexplode("words").alias("i", "w"))
    whole, begins = F.col("docs").isNull(), F.col("w") == int(START)
    grams = met.select(
        "k", "w", "x", F.when(whole, 2).when(begins, 1).otherwise(0).alias("kind"),
        F.when(whole, F.col("k")).otherwise(F.col("base") + F.get("docs", F.col("i"))).alias("r"), F.when(whole, F.col("base")).alias("doc_id"),
    )
    # A pair's own hash comes first in the sort: it tells rows apart where k and w have many ties.
    counted = grams.withColumn("c", F.count("*").over(Window.partitionBy(F.xxhash64("k", "w"), "w", "k")))
    log_total, of_doc = math.log(max(total, 1)), F.col("kind") == 2
    value = F.when(of_doc, F.col("x")).when(F.col("kind") == 1, F.col("x") - log_total).when(F.col("c") >= min_count, F.log("c") - F.col("x"))
    rows = counted.select("r", "doc_id", F.when(of_doc, F.col("w")).alias("n_words"), value.alias("s"), "w")
    if min_count > 1:  # every other pair has a count
        codes = spark.createDataFrame([(int(w), i) for i, w in enumerate(hot[0].view(np.int64), 1)], "hot long, code long")
        coded = words.join(F.broadcast(codes), F.col("word") == F.col("hot"), "left").select(F.coalesce("code", "word").alias("word"), "log_n")  # at most HOT
        rest = rows.where("s is null").join(coded.hint("merge"), F.col("w") == F.col("word"))
        none = F.lit(None).cast("long")
        rest = rest.select("r", none.alias("doc_id"), none.alias("n_words"), (F.col("log_n") + (math.log(alpha) - log_total)).alias("s"), "w")
        rows = rows.where("s is not null").union(rest)
    out = rows.groupBy("r").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("s").alias("log_score"))
    return out.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def digest(docs: DataFrame) -> DataFrame:
    """The query op4: doc_id, n_words, log_score and mean_log_score (to four places)."""
    out = score(docs)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


#: DuckDB SQL for the same rows (unique doc_ids, as in the tables).
ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
grams AS (
  SELECT doc_id, unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS v FROM words),
ones AS (SELECT w, count(*) AS c FROM grams GROUP BY w),
twos AS (SELECT v, w, count(*) AS c FROM grams WHERE v IS NOT NULL GROUP BY v, w),
total AS (SELECT count(*) AS n FROM grams),
scored AS (
  SELECT g.doc_id, CASE WHEN g.v IS NULL THEN ln(w1.c / n)
                        WHEN t.c IS NOT NULL THEN ln(t.c / v1.c)
                        ELSE ln(0.4 * w1.c / n) END AS s
  FROM grams g CROSS JOIN total JOIN ones w1 ON g.w = w1.w LEFT JOIN ones v1 ON g.v = v1.w
  LEFT JOIN twos t ON g.v = t.v AND g.w = t.w)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score,
       round(sum(s) / nullif(len(d.ws), 0), 4) AS mean_log_score
FROM words d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id, d.ws
"""
