"""Groups of spelling variants without pairs.

Words that differ by one replaced code point meet in wildcard groups: the word without what stands
at one position, keyed by (position, prefix, suffix). A group keeps its size and its two words of
largest count, which is all that a member needs: its near words there are the others, the best of
them is the first word, or the second for the first itself. Words that differ by one inserted code
point meet where a deletion of the longer one is a word: the group of that key keeps the word, how
many delete to it, and the best of those. No pair is made; a word gives as many rows as it has code
points, twice, and a group has at most as many members as there are letters (90) or, for
deletions, letters by positions.

Words are numbered in code-point order by a range sort, and groups carry numbers and counts only;
keys are four polynomial hashes modulo 2^31 - 1 (124 bits; among 10^11 keys two collide with a
chance of 1e-15), so a word of a million letters costs a million short rows and no square.

Defined cases: a null or empty text has no words; a null doc_id is empty in the hash's key.
Repeated rows count each. Ties go to the smaller word in code-point order. Texts are scanned in
slices that end between runs; a run is read whole. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.llm.common import forget, materialize, shuffled

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One run in so many is damaged, and how much more frequent a form must be.
DAMAGE = 97
RATIO = 2
#: Bytes of text scanned at a time, and distinct words that a task counts before it hands them on.
SLICE = 1 << 20
HELD = 200_000
#: Keys made at a time.
KEYS = 1 << 17

#: U+00C0 to U+00FF are C3 80 to C3 BF in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_MORE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])*")
_PRIME = np.uint64((1 << 31) - 1)
_BASES = np.random.default_rng(31).integers(1 << 20, (1 << 31) - 1, 4, np.uint64)
_WILD = np.uint64(1)  # no letter
#: A row's part in a key's group.
REPLACED, DELETED, WORD = 0, 1, 2


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The runs of letters of a text, A-Z lower-cased, slice by slice."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            if text[end - 1] == 0xC3:
                end += 1
            end = _MORE.match(text, end).end()
        yield _RUN.findall(text[at:end].lower())
        at = end


def written_as(run: bytes, seed: int) -> bytes:
    """The run as it counts; seed: the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run, seed)
    if h % DAMAGE:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of one task, in parts; words of too few code points are left out."""
    held: Counter = Counter()

    def parts() -> Iterator[pa.RecordBatch]:
        words = [w.decode() for w in held]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for found in runs(text or b""):
                for run, n in Counter(found).items():
                    if not zlib.crc32(run, seed) % DAMAGE:
                        run = written_as(run, seed)
                    if len(run) >= LEAST_LENGTH and len(run) - run.count(b"\xc3") >= LEAST_LENGTH:
                        held[run] += n
                if len(held) >= HELD:
                    yield from parts()
    if held:
        yield from parts()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n): words of all texts that occur often enough, numbered in code-point order."""
    texts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    counted = texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    ordered = materialize(counted, "words").repartitionByRange("word").sortWithinPartitions("word")
    # numbers grow with the partition, and partitions with their range; writing them fixes them
    return materialize(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _combined(prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of prefix + middle + suffix, the first two shifted already, as two longs."""
    h = (prefix + middle + suffix) % _PRIME
    return ((h[..., 0] << np.uint64(31) | h[..., 1]).astype(np.int64), (h[..., 2] << np.uint64(31) | h[..., 3]).astype(np.int64))


def _equal_length_keys(codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first key, second key, part) for words of one length; codes: (words, length)."""
    n, length = codes.shape
    values = codes.astype(np.uint64)
    powers = np.ones((length + 1, 4), np.uint64)
    for i in range(length):
        powers[i + 1] = powers[i] * _BASES % _PRIME
    head = np.zeros((length + 1, n, 4), np.uint64)  # of the first i letters
    for i in range(length):
        head[i + 1] = (head[i] * _BASES + values[:, i, None]) % _PRIME
    tail = np.zeros((n, 4), np.uint64)  # of the letters after i
    nothing = np.zeros((n, 4), np.uint64)
    part = lambda kind, m: np.full(m, kind, np.int8)
    yield (rows, *_combined(head[length], nothing, nothing), part(WORD, n))
    for i in range(length - 1, -1, -1):
        after = length - 1 - i
        yield (rows, *_combined(head[i] * powers[after + 1] % _PRIME, _WILD * powers[after], tail), part(REPLACED, n))
        if length > LEAST_LENGTH:
            # of a stretch of equal letters one deletion stands for all
            new = np.ones(n, bool) if i == 0 else codes[:, i] != codes[:, i - 1]
            if new.any():
                yield (rows[new], *_combined(head[i][new] * powers[after] % _PRIME, nothing[new], tail[new]), part(DELETED, int(new.sum())))
        tail = (values[:, i, None] * powers[after] + tail) % _PRIME


def keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the word, first key, second key, part) of all groups that the words are in."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, KEYS // int(length))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            codes = np.frombuffer("".join(words[j] for j in own).encode("utf-32-le"), np.uint32).reshape(len(own), length)
            yield from _equal_length_keys(codes, own)


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for rows, k1, k2, part in keys(batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(part), pa.array(ids[rows]), pa.array(counts[rows])], names=["k1", "k2", "part", "id", "n"])


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word with near words how many, and (n, -id) of the best."""
    rows = words.mapInArrow(_memberships, "k1 long, k2 long, part byte, id long, n long")
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("part"), F.desc("n"), "id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n", (-F.col("id")).alias("less"), "part")
    grouped = rows.select("id", "n", "part", F.count("*").over(group).alias("size"), F.first(one).over(group).alias("first"), F.nth_value(one, 2).over(group).alias("second"))
    # a word at its own key is the first of its group; the others there delete to it
    of_word = F.col("first.part") == WORD
    own = F.col("first.less") == -F.col("id")
    met = grouped.where(F.col("size") > 1).where(of_word | (F.col("part") == REPLACED))
    found = F.when(of_word & ~own, 1).otherwise(F.col("size") - 1)
    best = F.when(own, F.col("second")).otherwise(F.col("first"))
    met = met.select("id", found.alias("found"), F.struct(best["n"].alias("n"), best["less"].alias("less")).alias("best"))
    return met.groupBy("id").agg(F.sum("found").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (id, form), without cycles. (id, root): the end of each chain, by doubling: a word
    takes the form of its form until none has one, in rounds that grow with the logarithm of the
    longest chain."""
    steps = materialize(forms.select("id", F.col("form").alias("root"), F.lit(False).alias("ended")), "steps")
    while not steps.where("not ended").isEmpty():
        onward = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = steps.where("not ended").join(shuffled(onward), "root", "left")
        moved = moved.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNull().alias("ended"))
        before, steps = steps, materialize(steps.where("ended").union(moved), "steps")
        forget(before)
    return steps.select("id", "root")


def group_variants(docs: DataFrame, ratio: int = RATIO, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    words = vocabulary(docs, least_count)
    found = near(words)
    joined = words.join(shuffled(found), "id", "left")
    taken = F.col("best.n") >= ratio * F.col("n")
    joined = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.less")).alias("form"), F.when(taken, F.col("best.n")).alias("form_n"))
    joined = materialize(joined, "near")
    linked = joined.where("form is not null").select("id", "form")
    ends = roots(linked)
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    rooted = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    links = linked.join(shuffled(named), "form").join(shuffled(ends), "id").join(shuffled(rooted), "root").select("id", "form_word", "root_word")
    out = joined.drop("form").join(shuffled(links), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows by pairs of words; crc32 from its published polynomial, byte by byte.
ORACLE = r"""
WITH RECURSIVE
crc_step AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY 1, 2),
coded AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], list_concat(
      list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: unicode(x)::BIGINT),
      flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM runs, crc_table),
written AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM coded),
words AS (SELECT word, sum(k)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
wild AS (SELECT word, n, substr(word, 1, p - 1) || '?' || substr(word, p + 1) AS k FROM places),
less AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT a.word, w.word, w.n FROM less a JOIN words w ON a.k = w.word
  UNION ALL SELECT w.word, a.word, a.n FROM less a JOIN words w ON a.k = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM pairs GROUP BY 1),
form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n,
    CASE WHEN b.form_n >= 2 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.other_n = b.form_n) END AS form
  FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS reached, 0 AS step FROM form
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN form f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM form f JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY 1) r USING (word)
"""
