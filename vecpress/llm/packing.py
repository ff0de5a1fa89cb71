"""Best-fit-decreasing packing planned on a histogram of lengths.

Texts become token ids; only those longer than a sequence are cut, into full pieces and a
last shorter one. The driver sees one count for each length (at most 4096 numbers) and packs
counts: all pieces of one length go, as many at once as there are equal bins, to the bins
with the least room that takes them. The plan says for each length which ranks go to which
sequences at which offset; pieces take their slot by their rank within their length. Ranks
are numbered within (length, salt), so that a length of a third of all pieces is numbered by
many tasks.

Defined cases: a null doc_id is packed like any other. A null or empty text is the end id alone. Repeated rows are packed each on
its own; ties in length go by salt, doc_id, piece and the row's own salt. An empty table gives no pieces. Extra
columns are not carried: the result is pieces, to be joined on doc_id.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.llm.common import Recent, give_back, materialize, shuffled
from vecpress.llm.token_counts import byte_letters, lowered

TOKENS = 4096
END_ID = 1
#: Chunks of text whose ids a worker remembers.
CACHED = 120_000
#: Of those, what stays for the worker's next task.
KEPT = 20_000
#: Pieces that one numbering task should get at most.
RANKED = 250_000

_workers: dict[int, ChunkEncoder] = {}
#: A mark after an ASCII letter or digit and before white space is a chunk of its own.
_MARK = re.compile(rb"(?<=[A-Za-z0-9])[.,!?;:](?=\s|\Z)")
#: Printable ASCII and the letters from U+00C0 to U+00FF: their only normalisation is lower case.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _word_pattern(tokenizer_json: str) -> str | None:
    """The pattern of words, if matching it and then byte letters are all that the pre-tokenizer does."""
    steps = (json.loads(tokenizer_json)["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, letters = steps
    plain = split["behavior"] == "Removed" and split["invert"] and not letters["add_prefix_space"] and not letters["use_regex"]
    return split["pattern"].get("Regex") if plain else None


class ChunkEncoder:
    """Ids of texts, remembered by chunk between ASCII white space.

    The pre-tokenizer never joins across white space and normalisation acts within a chunk,
    so the ids of a text are those of its chunks in order. A chunk of plain letters is one
    word, which the merge table takes without the steps before it; a chunk of `_PLAIN`
    characters is cut into words by the tokenizer's own pattern. Added tokens are taken out
    of a text first, as the tokenizer does: they stand for their id and split what is around
    them. Those that it would look for in normalised text are not supported.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.single_word or not t.special for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must be special ones that are looked for in the text as it is")
        self.tokenizer.encode_special_tokens = True  # of chunks, which are lower-cased: added tokens are out by then
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        longest = sorted(added, key=len, reverse=True)
        self.split_added = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")").split if added else None
        self.letters = {b: c for c, b in byte_letters().items()}
        pattern = _word_pattern(tokenizer_json)
        self.words = regex.compile(pattern).findall if pattern else None
        self.known = Recent(CACHED, self._learn)

    def _learn(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters only
            ids = [t.id for t in self.tokenizer.model.tokenize(chunk.decode().lower())]
        elif self.words and _PLAIN(chunk):
            words = self.words(chunk.decode().lower())
            ids = [t.id for w in words for t in self.tokenizer.model.tokenize(self._byte_letters(w))]
        else:
            ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _byte_letters(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        marked = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if marked:
            return self._around_added(texts, marked)
        split = [_MARK.sub(rb" \g<0>", lowered(t or b"")).split() for t in texts]
        get = self.known.lookup()
        return [b"".join(map(get, chunks)) for chunks in split]

    def _around_added(self, texts: list[bytes | None], marked: list[int]) -> list[bytes]:
        """Texts that hold added tokens go by the stretches between them."""
        parts = {i: self.split_added(texts[i]) for i in marked}
        flat = [p for i in marked for p in parts[i][::2]]
        ids = iter(self.encode([None if i in parts else t for i, t in enumerate(texts)] + flat))
        out = [next(ids) for _ in texts]
        for i in marked:
            out[i] = b"".join(self.added[p] if n % 2 else next(ids) for n, p in enumerate(parts[i]))
        return out


def encoder(tokenizer_json: str) -> ChunkEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _workers:
        _workers.clear()
        _workers[key] = ChunkEncoder(tokenizer_json)
    return _workers[key]


def pieces(docs: DataFrame, tokenizer_path: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each text, cut into at most `tokens` ids."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows: list[list] = [[] for _ in names]
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), tokens * 4)):
                        own = ids[at : at + tokens * 4]
                        for column, value in zip(rows, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)
        coder.known.rest(KEPT)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, ranks, first sequence, ranks in each sequence, offset): rank
    first + i goes to sequence first_sequence + i // each, at offset + (i % each) * length.
    Every step uses up a length or a whole run of equal bins, so the plan's size follows the
    lengths, not the pieces.
    """
    out, made = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # space left: runs (first sequence, bins)
    spaces: list[int] = []  # the keys of room, sorted

    def put(space: int, first: int, bins: int) -> None:
        if space:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                bins = -(-left // each)
                full = left // each
                if full:
                    out.append((length, rank, full * each, made, each, 0))
                    put(capacity - each * length, made, full)
                if bins > full:
                    rest = left - full * each
                    out.append((length, rank + full * each, rest, made + full, rest, 0))
                    put(capacity - rest * length, made + full, 1)
                made += bins
                break
            space = spaces[at]
            first, bins = room[space].pop()
            each = space // length  # one bin is filled before the next, as its room stays the least
            used = min(bins, left // each)
            if used:
                out.append((length, rank, used * each, first, each, capacity - space))
                put(space - each * length, first, used)
                rank, left = rank + used * each, left - used * each
            if used < bins and left and left < each:
                out.append((length, rank, left, first + used, left, capacity - space))
                put(space - left * length, first + used, 1)
                used, left = used + 1, 0
            if used < bins:
                room[space].append((first + used, bins - used))
            if not room[space]:
                del room[space]
                spaces.remove(space)
    return out


def pack(parts: DataFrame, capacity: int = TOKENS, ranked: int = RANKED) -> DataFrame:
    """parts with sequence_id and offset (long). parts: doc_id, piece, length (1 to capacity)
    and whatever else; it is read twice, so pass a written table. A long column __salt deals the
    pieces of one length to numbering tasks, and tells rows apart that repeat doc_id and piece, so
    that a task that runs again numbers them alike; without it (doc_id, piece) deals, and rows that
    repeat both are numbered by one task, in any order."""
    spark = parts.sparkSession
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset", "__salt", "__tie")]
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    salts = max(16, -(-sum(counts.values()) // ranked))
    dealt = F.col("__salt") if "__salt" in parts.columns else F.xxhash64("doc_id", "piece")
    salted = parts.withColumn("__tie", dealt).withColumn("__salt", F.pmod(dealt, F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").count()
    before = "sum(count) over (partition by length order by __salt rows between unbounded preceding and 1 preceding)"
    firsts = sizes.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), F.expr(f"coalesce({before}, 0)").alias("__first"))
    firsts = shuffled(materialize(firsts, "firsts"))  # grows with the pieces; dealt as they are
    order = "row_number() over (partition by length, __salt order by doc_id, piece, __tie)"
    numbered = salted.withColumn("__row", F.expr(order) - 1)
    numbered = numbered.join(firsts, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s")))
    numbered = numbered.withColumn("__rank", F.col("__row") + F.col("__first"))

    steps = sorted(plan(counts, capacity))
    table = np.array(steps, np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(table)
    schema = parts.select(*kept).schema.add("sequence_id", "long").add("offset", "long")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        step = np.int64(1) << 44
        keys = rows[:, 0] * step + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            own = rows[np.searchsorted(keys, length * step + rank, "right") - 1]
            i = rank - own[:, 1]
            sequence, offset = own[:, 3] + i // own[:, 4], own[:, 5] + i % own[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return numbered.select(*kept, "__rank").mapInArrow(take, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their sequence and offset: the columns of the query op2, and ids on demand."""
    salt = F.xxhash64(F.monotonically_increasing_id())  # written with the pieces, so that all reads agree
    return pack(materialize(pieces(docs, tokenizer_path, tokens, with_ids=with_ids).withColumn("__salt", salt), "pieces"), tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids, in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.concat_ws("", F.transform(parts, lambda x: F.hex(x["ids"])))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(joined).alias("ids"))
