"""Language identification by a byte convolutional network.

Texts are cut into windows of WINDOW bytes, the last one padded. Filters of widths 2, 3 and 4
over one-hot bytes, a rectifier and the maximum over each window feed a softmax; a text's
probabilities are the mean over all its windows by length. The network is trained in numpy on
windows drawn from labelled texts.

Training rows are a bounded sample: at most PER_LANGUAGE distinct texts of each language, those
with the smallest hashes of their text, and WINDOWS windows of each; at most LANGUAGES
languages, those with the most labelled rows. The draw goes by text, never by doc_id, so rows
that share an id, or have none, are drawn like any others, and a text that fills a third of the
table is drawn once. Prediction reads every byte of every text.

Defined cases: an empty table gives no rows. A null text, or one without a letter, is `und` with score 0. With no labelled
text that is not empty every text is `und`. With a single language all others get it with
score 1. Repeated rows are predicted each; ties go to the language that sorts first. A row with
a null doc_id is not held out. Extra columns are kept; one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vecpress.llm.common import give_back

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bounds on the training sample: texts of each language, windows of each text, languages.
PER_LANGUAGE = 500
WINDOWS = 4
LANGUAGES = 256
EPOCHS = 8
UNDETERMINED = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as bytes (n, size), each one's text and its share of real bytes."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    padded = b"".join(t + b"\0" * (-len(t) % size) for t in texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    real = np.full(len(owner), size, np.float32)
    last = np.cumsum(counts) - 1
    for i in np.flatnonzero(counts):
        real[last[i]] = len(texts[i]) - (counts[i] - 1) * size
    return np.frombuffer(padded, np.uint8).reshape(-1, size), owner, real


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # for each width w: (w, 256, FILTERS), a filter's weight of each byte at each place
    bias: list[np.ndarray]
    dense: np.ndarray  # (features, languages)
    dense_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Filters as sums of lookups by byte pairs, which read less than lookups by byte."""
        out = []
        for f, b in zip(self.filters, self.bias, strict=True):
            parts = []
            for i in range(0, len(f) - 1, 2):
                parts.append((f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1))
            if len(f) % 2:
                parts.append(f[-1])
            parts[0] = parts[0] + b
            out.append(tuple(np.ascontiguousarray(p, np.float32) for p in parts))
        return out

    def features(self, rows: np.ndarray, tables: list[tuple[np.ndarray, ...]], block: int = 96) -> np.ndarray:
        out = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
        for i in range(0, len(rows), block):
            part = rows[i : i + block].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            for j, (width, parts) in enumerate(zip(WIDTHS, tables, strict=True)):
                n = part.shape[1] - width + 1
                total = np.take(parts[0], pairs[:, :n], axis=0)
                for k, table in enumerate(parts[1:], 1):
                    at = 2 * k
                    total += np.take(table, pairs[:, at : at + n] if len(table) == 65536 else part[:, at : at + n], axis=0)
                out[i : i + block, j * FILTERS : (j + 1) * FILTERS] = np.maximum(total.max(axis=1), 0)
        return out

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on cross-entropy; the maximum passes each filter's gradient to one place."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    net = Network(languages, filters, bias, dense, np.zeros(len(languages), np.float32))
    weights = [*filters, *bias, net.dense, net.dense_bias]
    moment, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = np.bincount(labels, minlength=len(languages)) / max(len(labels), 1)
    balance = (1 / np.maximum(share, 1e-9) / len(languages)).astype(np.float32)
    step, batch = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for i in range(0, len(order), batch):
            x, y = rows[order[i : i + batch]].astype(np.int64), labels[order[i : i + batch]]
            feats, places = [], []
            for f, b, w in zip(filters, bias, WIDTHS, strict=True):
                n = x.shape[1] - w + 1
                total = sum(f[k][x[:, k : k + n]] for k in range(w)) + b
                place = total.argmax(axis=1)
                places.append(place)
                feats.append(np.maximum(np.take_along_axis(total, place[:, None, :], 1)[:, 0], 0))
            h = np.concatenate(feats, axis=1)
            p = net.probabilities(h)
            p[np.arange(len(y)), y] -= 1
            p *= balance[y][:, None] / len(y)
            gh = p @ net.dense.T * (h > 0)
            grads: list[np.ndarray] = []
            cols = np.arange(FILTERS)
            for j, (f, w, place) in enumerate(zip(filters, WIDTHS, places, strict=True)):
                g, own = np.zeros_like(f), gh[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    seen = np.take_along_axis(x, place + k, 1)
                    np.add.at(g[k], (seen, np.broadcast_to(cols, seen.shape)), own)
                grads.append(g)
            grads += [gh[:, j * FILTERS : (j + 1) * FILTERS].sum(axis=0) for j in range(len(WIDTHS))]
            grads += [h.T @ p + 1e-4 * net.dense, p.sum(axis=0)]
            step += 1
            for w, g, m, s in zip(weights, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, use: Column, per_language: int = PER_LANGUAGE, per_text: int = WINDOWS, languages: int = LANGUAGES) -> Network | None:
    """Train on the rows of docs that `use` admits and whose lang is not null."""
    known = docs.where(use & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return None
    # A draw by chance leaves little more than what is wanted; the smallest hashes of it are the
    # smallest of all, so the sample does not depend on the estimate of distinct texts.
    chance = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * per_language / r["texts"] + 20 / r["texts"]))))
    u = F.xxhash64("h", F.lit(3)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = known.withColumn("u", u).where(F.col("u") < F.try_element_at(chance, F.col("lang")))
    drawn = drawn.groupBy("lang", "h", "u").agg(F.min("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))
    sample = drawn.withColumn("rank", order).where(F.col("rank") <= per_language)
    # so many windows of each text, at places spread over all of it
    n = F.length("text")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_text - 1)), lambda i: F.floor(i * F.greatest(n - WINDOW // 2, F.lit(0)) / max(per_text - 1, 1)).cast("int") + 1))
    cut = sample.select("lang", "rank", F.explode(starts).alias("at"), "text").select("lang", "rank", "at", F.substring("text", F.col("at"), F.lit(WINDOW)).alias("part"))
    got = cut.toArrow().sort_by([("lang", "ascending"), ("rank", "ascending"), ("at", "ascending")])
    parts, langs = [p.encode()[:WINDOW] for p in got["part"].to_pylist()], got["lang"].to_pylist()
    names = sorted(set(langs))
    rows = np.zeros((len(parts), WINDOW), np.uint8)
    for i, p in enumerate(parts):
        rows[i, : len(p)] = np.frombuffer(p, np.uint8)
    return train(rows, np.array([names.index(x) for x in langs], np.int64), names)


def predict_texts(net: Network | None, tables: list, texts: list[bytes | None]) -> list[tuple[str, float]]:
    lettered = [i for i, t in enumerate(texts) if net and has_letter(t)]
    out = [(UNDETERMINED, 0.0)] * len(texts)
    if not lettered:
        return out
    total = np.zeros((len(lettered), len(net.languages)))
    rows, owner, real = windows([texts[i] for i in lettered])
    for i in range(0, len(rows), 4096):
        p = net.probabilities(net.features(rows[i : i + 4096], tables))
        np.add.at(total, owner[i : i + 4096], p * real[i : i + 4096, None])
    total /= total.sum(axis=1, keepdims=True)
    for i, best, score in zip(lettered, total.argmax(axis=1), total.max(axis=1), strict=True):
        out[i] = (net.languages[best], min(1.0, float(score)))
    return out


def predict(docs: DataFrame, net: Network | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, and the language and its probability under `names`."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in keep if c not in names]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else []
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                found = predict_texts(net, tables, batch.column("__text").to_pylist())
                new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *names])
        del tables
        give_back()

    return docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


def held_out() -> Column:
    """crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the documents that are not held out, then predict all of them."""
    return predict(docs, fit(docs, ~held_out()), keep, names)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op3: doc_id, held_out, lang_pred, score."""
    return identify(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
