"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents become sets of five-word shingles (words: runs of letters and digits,
lower-cased). A short item hides in a long document, where the similarity of the whole sets
says nothing; so items are partitioned by the number of their shingles, and for each
partition documents are read in overlapping windows a little longer than its largest item.
A window and an item that share any of HASHES minima make a candidate. With the windows of
one quarter more than the largest item, a contained item is missed with a chance of 1e-5 at
worst, and a whole copy of one with 1e-7. Items
of up to SHORT shingles have windows of one shingle, whose minimum is the shingle itself:
there every shared shingle makes a candidate.

Candidates are verified by the exact share of the item's distinct shingles (as strings) that
the whole document holds; pairs at THRESHOLD or more are the result.

What documents are tested against while they are read is two bit tables, filled from the
items' minima and shingles; a bit set by chance costs a candidate that the joins then drop.
They have SPARSE bits for each entry, up to MOST_BITS (64 MB each); a benchmark of more than a
million long items fills them further, which costs candidates but loses none.

Defined cases: empty tables hold and match nothing. Null or empty texts, and those without words, hold nothing and match nothing.
A text of one to four words is one shingle, its whole word sequence. Equal items under
different ids are found each. An item_id that comes with several texts names several items,
each held against documents on its own and reported with its own figures; rows that repeat
both are one. The same goes for documents that share a doc_id: each text is searched on its
own, and `decontaminate` drops the rows that hold an item, not those beside them. Rows with a
null doc_id or item_id name nothing and take no part (`decontaminate` keeps such documents).
Extra columns are ignored by the search and kept by `decontaminate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.llm.common import give_back, materialize, small

WORDS = 5
THRESHOLD = 0.8
HASHES = 32
#: Items of up to so many shingles are found by any shared shingle.
SHORT = 8
#: Bits of the tables that documents are tested against: for each entry, at least, at most.
SPARSE = 256
LEAST_BITS = 1 << 24
MOST_BITS = 1 << 29
#: Characters whose words are hashed at a time, about.
CHARS = 1 << 20
#: Shingles of a document that are held against all hash functions at a time.
SEGMENT = 4096

_WORD = re.compile(r"[^\W_]+")
_ODD = np.random.default_rng(17).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(19).integers(1, 1 << 63, HASHES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokenize(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], width: int = WORDS) -> list[str]:
    """In order, repeats included."""
    if not words:
        return []
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@cache
def _letters() -> np.ndarray:
    """Which code points belong to words: those of `_WORD`."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


class Words:
    """The words of a text, as `tokenize` gives them, with a 64-bit hash of each: made for all
    characters at a time, so that strings are cut out only where they are asked for."""

    def __init__(self, text: str | None):
        self.text = (text or "").lower()
        if self.text.isascii():
            codes, known = np.frombuffer(self.text.encode(), np.uint8), _ASCII
        else:
            codes, known = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32), _letters()
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = known[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(codes) + CHARS, CHARS)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # bounded memory for very long texts
            self.hashes[i:j] = _hashed(codes, inside[1:-1], self.starts[i:j], int(self.ends[j - 1]))

    def __len__(self) -> int:
        return len(self.starts)

    def shingle(self, k: int, width: int) -> str:
        return " ".join([self.text[a:b] for a, b in zip(self.starts[k : k + width].tolist(), self.ends[k : k + width].tolist(), strict=True)])


def _hashed(codes: np.ndarray, inside: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Hashes of the words that begin at `starts`, the last of which ends at `end`: sums of their
    scrambled characters, each times the power of its place in the word."""
    first = int(starts[0])
    part, at = codes[first:end], starts - first
    value = _VALUES[part] if part.dtype == np.uint8 else _scramble((part + np.uint64(1)) * _MIX)
    place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
    value = value * _POWERS[place & (len(_POWERS) - 1)] * inside[first:end]
    return _scramble(np.add.reduceat(value, at))


def shingle_hashes(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """One hash for each shingle position, from the word hashes."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = _scramble(out + words[k : k + n])
    return out


_ASCII = np.array([chr(c).isalnum() for c in range(128)])
_VALUES = _scramble((np.arange(128, dtype=np.uint64) + np.uint64(1)) * _MIX)
_POWERS = np.multiply.accumulate(np.full(4096, 0xD1342543DE82EF95, np.uint64))


def size_class(n: int) -> int:
    """0 for short items, else the power of two that bounds the number of shingles."""
    return 0 if n <= SHORT else (n - 1).bit_length()


def _mark(which: int, size: int) -> int:
    """Tells apart the minima of one hash function and size class from all others."""
    return (size << 8 | which) * 0x2545F4914F6CDD1D & (2**64 - 1)


@cache
def _marks(size: int) -> np.ndarray:
    """Those of all minima of a size class, a row each."""
    return np.array([[_mark(j, size)] for j in range(HASHES)], np.uint64)


def _signed(values: np.ndarray, which: int, size: int) -> np.ndarray:
    """Join keys of minimum number `which` in size class `size`."""
    return values ^ np.uint64(_mark(which, size))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Join keys of an item: its shingles if it is short, else its minima."""
    distinct = np.unique(hashes)
    size = size_class(len(distinct))
    if size == 0:
        return _signed(distinct, 255, 0)
    return np.array([_signed((distinct * _ODD[j] + _ADD[j]).min(keepdims=True), j, size)[0] for j in range(HASHES)], np.uint64)


def window_keys(hashes: np.ndarray, sizes: list[int], admit) -> np.ndarray:
    """Distinct join keys of all windows of a document that `admit` lets through."""
    out = []
    if 0 in sizes:
        out.append(admit(_signed(hashes, 255, 0)))
    longer = sorted(s for s in sizes if s)
    if longer:
        overlap = 5 << (longer[-1] - 2)
        step = max(SEGMENT, 4 * overlap)
        for i in range(0, max(1, len(hashes) - overlap), step):  # very long documents by parts that overlap by a window
            out += _minima(hashes[i : i + step + overlap], longer, admit)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _minima(hashes: np.ndarray, sizes: list[int], admit) -> Iterator[np.ndarray]:
    """Admitted keys of the minima of each window: five blocks, each a quarter of the largest item."""
    block = 1 << (sizes[0] - 2)
    if len(hashes) % block:  # the last one again fills the last block and moves no minimum
        hashes = np.concatenate([hashes, np.repeat(hashes[-1:], -len(hashes) % block)])
    level = None
    for place in np.ascontiguousarray(hashes.reshape(-1, block).T):  # the i-th shingles of all blocks
        own = place * _ODD[:, None]
        own += _ADD[:, None]
        level = own if level is None else np.minimum(level, own, out=level)
    for s in range(sizes[0], sizes[-1] + 1):
        if s != sizes[0]:
            odd = level[:, -1:] if level.shape[1] % 2 else level[:, :0]
            level = np.minimum(level[:, : level.shape[1] - odd.shape[1] : 2], level[:, 1::2])
            level = np.concatenate([level, odd], axis=1) if odd.size else level
        if s in sizes:
            low = level.min(axis=1, keepdims=True) if level.shape[1] < 5 else np.minimum(level[:, :-1], level[:, 1:])
            if level.shape[1] > 4:
                low = np.minimum(low[:, :-2], low[:, 2:])
                low = np.minimum(low[:, :-1], level[:, 4:], out=low[:, :-1])
            yield admit((low ^ _marks(s)).ravel())


def _bits(values: np.ndarray, bits: int) -> np.ndarray:
    return (values & np.uint64(bits - 1)).astype(np.int64)


def _set(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set in a packed table."""
    byte = table[((values >> np.uint64(3)) & np.uint64(len(table) - 1)).view(np.int64)]
    return (byte << (values.astype(np.uint8) & np.uint8(7)) & np.uint8(128)) != 0


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = Words(text)
            if len(words):
                h = shingle_hashes(words.hashes)
                rows.append((item, row, size_class(len(np.unique(h))), signature(h).view(np.int64), h.view(np.int64), list(dict.fromkeys(shingles(tokenize(text))))))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["item_id", "row", "size", "keys", "hashes", "shingles"])


def table_bits(entries: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(entries, 1) * SPARSE - 1).bit_length()))


def _tables(items: DataFrame, entries: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the items' keys and shingles: made by few tasks, joined on the driver."""
    bits = [table_bits(n) for n in entries]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [np.zeros(n // 8, np.uint8) for n in bits]
        for batch in batches:
            for table, name in zip(made, ("keys", "hashes"), strict=True):
                at = _bits(batch.column(name).flatten().to_numpy(zero_copy_only=False).view(np.uint64), 8 * len(table))
                np.bitwise_or.at(table, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in made], names=["a", "b"])

    out = [np.zeros(n // 8, np.uint8) for n in bits]
    for row in items.select("keys", "hashes").coalesce(4).mapInArrow(fill, "a binary, b binary").toLocalIterator():
        for o, r in zip(out, row, strict=True):
            o |= np.frombuffer(r, np.uint8)
    return out[0], out[1]


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) of the items that documents contain.

    docs: doc_id, text; items: item_id, text. shingles counts the item's distinct shingles.
    """
    return _found(docs, items, threshold).drop("doc_row")


def _found(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """contained, with the hash of the document's text as doc_row."""
    spark = docs.sparkSession
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("row"), "text").distinct()
    known = materialize(rows.mapInArrow(_item_rows, "item_id long, row long, size int, keys array<long>, hashes array<long>, shingles array<string>"), "items")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # one for each power of two
    entries = known.agg(F.sum(F.size("keys")), F.sum(F.size("hashes"))).head()
    sent = spark.sparkContext.broadcast((*_tables(known, (entries[0] or 0, entries[1] or 0)), sizes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_table, shingle_table, sizes = sent.value

        def admit(keys: np.ndarray) -> np.ndarray:
            return keys[np.flatnonzero(_set(keys_table, keys))]

        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                rows = []
                for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = Words(text) if sizes else ()
                    if not len(words):
                        continue
                    h = shingle_hashes(words.hashes)
                    keys = window_keys(h, sizes, admit)
                    if len(keys):
                        at = np.flatnonzero(_set(shingle_table, h)).tolist()
                        rows.append((doc, row, keys.view(np.int64), list({words.shingle(k, WORDS) for k in at})))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "doc_row", "keys", "held"])
        del admit
        give_back()

    hits = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_row"), "text")
    hits = materialize(hits.mapInArrow(read, "doc_id long, doc_row long, keys array<long>, held array<string>"), "hits")
    doc, item = ["doc_id", "doc_row"], ["item_id", "row"]
    by_key = known.select(*item, F.explode("keys").alias("key")).distinct()
    candidates = hits.select(*doc, F.explode("keys").alias("key")).join(small(by_key), "key").select(*doc, *item).distinct()
    # only candidates are verified: a shingle that all documents and many items share makes none by itself
    of_items = known.select(*item, F.array_join("shingles", "\n").alias("of_item"))
    pairs = candidates.join(small(of_items), item).join(hits.select(*doc, "held").dropDuplicates(doc), doc)
    of_item = F.split("of_item", "\n")
    pairs = pairs.select(*doc, "item_id", F.size(F.array_intersect("held", of_item)).cast("long").alias("shared"), F.size(of_item).cast("long").alias("shingles"))
    return pairs.where(F.col("shared") >= threshold * F.col("shingles")).withColumn("containment", F.col("shared") / F.col("shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item."""
    bad = _found(docs, items, threshold).select(F.col("doc_id").alias("__bad"), F.col("doc_row").alias("__row")).distinct()
    bad = small(materialize(bad, "contaminated"))
    return docs.join(bad, (F.col("doc_id") == F.col("__bad")) & (F.xxhash64("text") == F.col("__row")), "left_anti")
