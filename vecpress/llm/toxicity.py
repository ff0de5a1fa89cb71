"""Toxicity by maximum-scoring segments.

Each word has a score: the log-odds of toxic against other labelled texts. A word's odds have a
Dirichlet prior centred on those of its longest known stem (3 to STEM letters), a stem's on those
of the next shorter one, the shortest's on even odds; so a rare word takes what its stem says.
Less a cost a word, scores are negative almost everywhere, and a linear scan finds all maximal
scoring segments of a text, each better than anything it overlaps (Ruzzo and Tompa). Segments are
calibrated by extreme-value statistics fitted on clean texts (Karlin and Altschul): a segment's
expected number by chance in a text of its length is K n exp(-lambda score); those with at most
SIGNIFICANT are passages. The passages of a text are summed with the statistic for several
segments, and one logistic step makes a probability of it.

Learning reads a bounded sample: at most PER_CLASS labelled documents of each label, those with
the smallest hashes of their ids, and at most UNITS words and stems, those with the most weight of
evidence. Counts go by distinct contexts (a word with two neighbours on each side), so that copies
count once. Calibration uses scores of each half of the sample under the odds of the other half.
Scoring reads every word of every text.

Defined cases: a null or empty text, or one without a letter, has score 0 and no passage. Without
labelled texts of both classes every score is 0. A doc_id that is labelled twice is toxic if one
of its labels says so; null labels and null ids teach nothing, and a row with a null doc_id is not
held out. Repeated rows are scored each. Texts of any length are read in slices of SLICE
characters that end between words; words beyond LONGEST letters go by their stems. Extra columns
are kept; one named like an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from vecpress.llm.common import Recent, forget, materialize

#: Bounds on what is learned from: documents of each label, and words and stems with odds of their own.
PER_CLASS = 5000
UNITS = 100_000
#: Lengths of stems, the weight of a prior in words, the range of a score and a word's cost.
SHORT, STEM = 3, 8
PRIOR = 10.0
#: Of the occurrences of one word, so many count for its stems, so that they tell of many words.
EACH = 3.0
RANGE = (-4.0, 8.0)
COST = 0.5
SIGNIFICANT = 0.1
TOXIC = 0.7
SLICE = 1 << 18
LONGEST = 64
#: Words whose scores a worker remembers.
CACHED = 200_000
#: Segments whose sum is looked at.
MOST = 200
#: Steps of a unit of score in the histogram of clean words.
STEPS = 16

_WORD = regex.compile(r"\p{L}+")
_MORE = regex.compile(r"\p{L}*")


def slices(text: str) -> Iterator[tuple[int, str]]:
    """(place, part): the text in parts that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            end = _MORE.match(text, end).end()
        yield at, text[at:end]
        at = end


def words(part: str) -> list[str]:
    return _WORD.findall(part.lower())


def units(word: str) -> list[str]:
    """The stems of a word, shortest first, and the word itself."""
    return [f"{word[:k]}*" for k in range(SHORT, min(STEM, len(word) - 1) + 1)] + [word] * (len(word) <= LONGEST)


class Segments:
    """All maximal scoring segments of a stream of scores, in linear time.

    Each entry is (first word, words before its end, total before it, total at its end). A new
    run of positive scores goes back over entries that start higher than it; if the one it meets
    ends lower than it does, all from there on become one, and the search goes on.
    """

    def __init__(self):
        self.total, self.n, self.entries = 0.0, 0, []

    def feed(self, scores: np.ndarray) -> None:
        up = np.flatnonzero(scores > 0)
        if len(up):
            totals = np.concatenate([[self.total], self.total + np.cumsum(scores)])
            breaks = np.flatnonzero(np.diff(up) > 1)
            first, last = up[np.concatenate([[0], breaks + 1])], up[np.concatenate([breaks, [len(up) - 1]])]
            entries = self.entries
            for a, b, low, high in zip((first + self.n).tolist(), (last + 1 + self.n).tolist(), totals[first].tolist(), totals[last + 1].tolist(), strict=True):
                while True:
                    j = len(entries) - 1
                    while j >= 0 and entries[j][2] >= low:
                        j = entries[j][4]  # entries between start no lower than that one
                    if j < 0 or entries[j][3] >= high:
                        entries.append((a, b, low, high, j))
                        break
                    a, low = entries[j][0], entries[j][2]
                    del entries[j:]
            self.total = float(totals[-1])
        else:
            self.total += float(scores.sum())
        self.n += len(scores)

    def found(self) -> list[tuple[float, int, int]]:
        """(score, first word, words before its end), in order of place."""
        return [(high - low, a, b) for a, b, low, high, _ in self.entries]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    out = Segments()
    out.feed(np.asarray(scores, np.float64))
    return out.found()


@dataclass
class Tail:
    """Segments by chance: K n exp(-rate score) of them reach a score in n words."""

    rate: float
    k: float

    def expected(self, score: float, n: int) -> float:
        return self.k * n * math.exp(-self.rate * score)

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln of the chance of the best r segments together, for the r that makes it least, by
        the tail of a sum of r extreme values; only significant segments count."""
        best = total = 0.0
        for r, score in enumerate(sorted(scores, reverse=True)[:MOST], 1):
            own = self.rate * score - math.log(self.k * max(n, 1))
            total += own
            if own < -math.log(SIGNIFICANT):
                break
            # e^-T T^(r-1) / (r! (r-1)!), and 2^-r for the choice of r
            here = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2.0)
            best = max(best, here if r > 1 else total)
        return best


def fit_tail(histogram: np.ndarray, low: float, tops: np.ndarray, n: int) -> Tail:
    """histogram: clean words by score, in steps from `low`; tops: segment scores in those words.
    The rate solves E exp(rate score) = 1; K fits the upper tenth of the segments."""
    share = histogram / max(histogram.sum(), 1)
    at = low + (np.arange(len(histogram)) + 0.5) / STEPS
    a, b = 1e-3, 8.0
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (mid, b) if (share * np.exp(mid * at)).sum() < 1 else (a, mid)
    rate = max(a, 0.05)
    tops = np.sort(tops)[::-1]
    ranks = np.arange(1, len(tops) + 1)
    # the highest few are mislabelled texts, the lowest many are no tail
    some = (ranks >= min(20, len(tops))) & (ranks <= max(20, len(tops) // 10))
    k = float(np.median(ranks[some] * np.exp(np.minimum(rate * tops[some], 100.0))) / max(n, 1)) if len(tops) else 1.0
    return Tail(rate, min(max(k, 1e-6), 10.0))


def fit_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(toxic | z), by Newton steps with a weak pull to zero."""
    x, w = np.stack([z, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
    return max(float(w[0]), 0.0), float(w[1])


@dataclass
class Odds:
    """Scores of words from weighted counts of units by class."""

    counts: dict[str, tuple[float, float]]  # toxic, other, both as shares of a class of the same size

    def score(self, word: str) -> float:
        share = 0.5
        for unit in units(word):
            toxic, other = self.counts.get(unit, (0.0, 0.0))
            share = (toxic + PRIOR * share) / (toxic + other + PRIOR)
        return min(max(math.log(share / (1 - share)), RANGE[0]), RANGE[1]) - COST


@dataclass
class Model:
    odds: Odds
    tail: Tail
    slope: float
    offset: float

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * math.sqrt(evidence) + self.offset, -30), 30)))


class Scorer:
    """Segments of texts under some odds; words are remembered."""

    def __init__(self, odds: Odds):
        self.known = Recent(CACHED, odds.score)

    def scores(self, text: str) -> Iterator[np.ndarray]:
        """Scores of its words, slice by slice; a word that repeats the one before it adds nothing."""
        before = None
        for _, part in slices(text):
            get, found = self.known.lookup(), words(part)
            if found:
                out = np.fromiter(map(get, found), np.float64, len(found))
                again = np.fromiter(map(eq, found, chain((before,), found)), bool, len(found))
                before = found[-1]
                yield np.where(again, np.minimum(out, -COST), out)

    def scan(self, text: str) -> Segments:
        out = Segments()
        for own in self.scores(text):
            out.feed(own)
        return out


def held_out() -> Column:
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of the documents that are learned from, and the number of labelled ones by y."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("__y"))
    known = known.withColumn("__u", F.xxhash64("__id", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    sizes = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return docs.select(F.lit(0).alias("y"), "text").limit(0), sizes
    chance = F.when(F.col("__y") == 1, min(1.0, (1.5 * per_class + 40) / sizes[1])).otherwise(min(1.0, (1.5 * per_class + 40) / sizes[0]))
    rank = F.row_number().over(Window.partitionBy("__y").orderBy("__u", "__id"))
    drawn = known.where(F.col("__u") < chance).withColumn("__r", rank).where(F.col("__r") <= per_class).select("__id", "__y")
    # at most 2 * per_class rows
    return docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select(F.col("__y").alias("y"), "text"), sizes


def _half(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 13) & 1


def count_units(texts: DataFrame, most: int = UNITS) -> tuple[list[tuple[str, int, float, float]], dict[tuple[int, int], int]]:
    """(unit, half, toxic, other) of the units with the most evidence, by distinct contexts, and
    the distinct contexts of each (y, half)."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                half = _half(text or "")
                for _, part in slices(text or ""):
                    found = words(part)
                    if not found:
                        continue
                    padded = ["", "", *found, "", ""]
                    own = [digest(" ".join(padded[i : i + 5]).encode("utf-8", "replace")) for i in range(len(found))]
                    n = len(found)
                    columns = [pa.array(np.array(own, np.uint64).view(np.int64)), pa.array([w[:LONGEST + 1] for w in found], pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, y, np.int32)), pa.array(np.full(n, half, np.int32))], names=["context", "word", "y", "half"])

    seen = texts.mapInArrow(contexts, "context long, word string, y int, half int").distinct()
    by_word = materialize(seen.groupBy("word", "half").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")), "word-counts")
    totals = {(y, h): 0 for y in (0, 1) for h in (0, 1)}
    for r in by_word.groupBy("half").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).collect():
        totals[1, r["half"]], totals[0, r["half"]] = r["t"], r["o"]
    even = sum(totals[1, h] for h in (0, 1)) / max(sum(totals[0, h] for h in (0, 1)), 1)
    stems = F.filter(F.sequence(F.lit(SHORT), F.lit(STEM)), lambda k: k < F.length("word"))
    own = F.when(F.length("word") <= LONGEST, F.array(F.struct("word", F.lit(1.0).alias("share")))).otherwise(F.array().cast("array<struct<word:string,share:double>>"))
    share = F.least(F.lit(1.0), EACH / (F.col("toxic") + even * F.col("other")))
    stem = F.transform(stems, lambda k: F.struct(F.concat(F.substring(F.col("word"), F.lit(1), k), F.lit("*")).alias("word"), share.alias("share")))
    each = by_word.select("toxic", "other", "half", F.explode(F.concat(stem, own)).alias("u"))
    counted = each.groupBy(F.col("u.word").alias("unit")).agg(*(F.sum(F.when(F.col("half") == h, F.col(c) * F.col("u.share")).otherwise(0.0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "other")))
    weight = F.round(F.col("toxic0") + F.col("toxic1") + even * (F.col("other0") + F.col("other1")), 6)
    top = counted.where(weight > 0.5).orderBy(F.desc(weight), "unit").limit(most).toArrow().to_pylist()
    forget(by_word)
    return [(r["unit"], h, r[f"toxic{h}"], r[f"other{h}"]) for r in top for h in (0, 1)], totals


def _odds(counted: list[tuple[str, int, float, float]], totals: dict[tuple[int, int], int], halves: tuple[int, ...]) -> Odds:
    even = sum(totals[1, h] for h in halves) / max(sum(totals[0, h] for h in halves), 1)
    out: dict[str, tuple[float, float]] = {}
    for unit, half, toxic, other in counted:
        if half in halves and (toxic or other):
            t, o = out.get(unit, (0.0, 0.0))
            out[unit] = (t + toxic, o + other * even)
    return Odds(out)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = UNITS) -> Model | None:
    texts, sizes = sample(docs, labels, per_class)
    if len(sizes) < 2:
        return None
    counted, totals = count_units(texts, most)
    if not all(sum(totals[y, h] for h in (0, 1)) for y in (0, 1)):
        return None
    crossed = [_odds(counted, totals, (1 - h,)) for h in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(crossed)
    low, size = RANGE[0] - COST, int((RANGE[1] - RANGE[0]) * STEPS) + 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's hash, label, words, segment scores, and histogram of word scores if clean."""
        scorers = [Scorer(o) for o in sent.value]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, half = text or "", _half(text or "")
                histogram, out = np.zeros(size, np.int64), Segments()
                for scores in scorers[half].scores(text):
                    out.feed(scores)
                    if not y:
                        histogram += np.bincount(np.clip((scores - low) * STEPS, 0, size - 1).astype(int), minlength=size)
                tops = sorted((s for s, _, _ in out.found()), reverse=True)[:MOST]
                digest = np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))).view(np.int64)
                for column, value in zip(rows, (int(digest), y, out.n, tops, [] if y else histogram.tolist()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["h", "y", "n", "tops", "histogram"])

    schema = "h long, y int, n long, tops array<double>, histogram array<long>"
    # at most 2 * per_class rows, of at most MOST scores each; one for each text
    each = texts.mapInArrow(scored, schema).groupBy("h").agg(F.max_by(F.struct("y", "n", "tops", "histogram"), "y").alias("r")).select("r.*").toArrow()
    y, n = each["y"].to_numpy(), each["n"].to_numpy()
    tops, counts = each["tops"].to_pylist(), each["histogram"].to_pylist()
    clean = np.flatnonzero(y == 0)
    if not len(clean) or len(clean) == len(y):
        return None
    histogram = np.sum([counts[i] for i in clean], axis=0)
    tail = fit_tail(histogram, low, np.array([s for i in clean for s in tops[i]]), int(n[clean].sum()))
    z = np.sqrt([tail.evidence(t, m) for t, m in zip(tops, n, strict=True)])
    share = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, share / max(int((y == 1).sum()), 1), (1 - share) / len(clean)) * len(y)
    slope, offset = fit_logistic(z, y.astype(float), weight)
    return Model(_odds(counted, totals, (0, 1)), tail, slope, offset)


PASSAGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])


def _places(text: str, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters of the text that the word ranges span."""
    ends = sorted({i for a, b in wanted for i in (a, b - 1)})
    at, i, out = 0, 0, {}
    for place, part in slices(text):
        lowered = part.lower()
        # a few letters change their length in lower case; their slices are searched as they are
        for m in _WORD.finditer(lowered if len(lowered) == len(part) else part):
            if i < len(ends) and at == ends[i]:
                out[at], i = (place + m.start(), place + m.end()), i + 1
            at += 1
    last = (len(text), len(text))
    return [(out.get(a, last)[0], out.get(b - 1, last)[1]) for a, b in wanted]


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, with score and passages: (start, end, score, expected) of each
    significant segment, in characters of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("score", "passages")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("passages", ArrayType(PASSAGE))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model.odds) if model else None
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                scores, passages = [], []
                for text in batch.column("__text"):
                    text = text.as_py() or ""
                    seen = scorer.scan(text) if model else Segments()
                    found = seen.found()
                    some = [(s, a, b, e) for s, a, b in found if (e := model.tail.expected(s, seen.n)) <= SIGNIFICANT]
                    spans = _places(text, [(a, b) for _, a, b, _ in some]) if some else []
                    scores.append(model.probability(model.tail.evidence([s for s, _, _ in found], seen.n)) if seen.n else 0.0)
                    passages.append([{"start": x, "end": y, "score": s, "expected": e} for (s, _, _, e), (x, y) in zip(some, spans, strict=True)])
                new = [pa.array(scores, pa.float64()), pa.array(passages, kind)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "score", "passages"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Learns from the labelled documents that are not held out, then scores all."""
    return predict(docs, fit(docs, labels), keep)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query op11, and n_passages."""
    out = score(docs, labels, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
