"""Greedy longest-match piece counts by a linear automaton.

The vocabulary becomes a trie. Each node has a failure link, the node of what is left of its
string once the greedy longest pieces are taken off its front, and a count of those pieces.
Scanning a word, a character that does not extend the node adds the node's count and follows
its link; each character is read once and no piece is built. Words are counted once for each
worker and remembered.

A word is what the tokenizer's pre-tokenizer yields after its normalisation (NFC, lower case):
a run of letters, one number, a run of other signs or a contraction ending, as UTF-8 bytes,
the last of which carries the word-end mark. All single bytes are pieces, with and without
the mark, so every word has a count.

Defined cases: an empty table gives no rows; a null doc_id is kept; texts of any length
are read whole. A null or empty text, or one of white space, has no words and no pieces.
Repeated rows are counted each; extra columns are kept, save one named like an output.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecpress.llm.common import Recent

#: The pre-tokenizer's pattern and the word-end mark of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Chunks of text whose counts a worker remembers.
CACHED = 200_000

_END = 256  # symbols from here on are bytes with the word-end mark
_workers: dict[int, Automaton] = {}


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 signs
    stand for themselves, the other bytes in order for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def symbols(token: str, letters: dict[str, int]) -> tuple[int, ...]:
    body = [letters[c] for c in token.removesuffix(WORD_END)]
    return closed(body) if token.endswith(WORD_END) else tuple(body)


def closed(body: list[int] | bytes) -> tuple[int, ...]:
    """Bytes of a word; its last one, which carries the word-end mark, is a symbol of its own."""
    return (*body[:-1], _END + body[-1])


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]):
        """pieces: symbol sequences; every single symbol that can occur must be among them."""
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for s in piece:
                to = self.next[node].get(s)
                if to is None:
                    to = self.next[node][s] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = to
            final[node] = bool(piece)
        # fail[v], pops[v]: what remains of v's string, and how many pieces went before it
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                at, popped = self.fail[u], self.pops[u]
                while at >= 0 and s not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.next[at][s], popped

    def count(self, word: tuple[int, ...] | list[int]) -> int:
        """Pieces of greedy longest match from the left; -1 if some symbol is in no piece."""
        follow, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for s in word:
            while s not in follow[node]:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = follow[node][s]
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else -1


def load(tokenizer_json: str) -> Automaton:
    vocab = json.loads(tokenizer_json)["model"]["vocab"]
    letters = byte_letters()
    return Automaton([symbols(t, letters) for t in vocab if all(c in letters for c in t.removesuffix(WORD_END))])


def lowered(text: bytes) -> bytes:
    """UTF-8 text with A-Z in lower case, which the normaliser does anyway; as it is where a letter
    may yet be composed with a mark (U+0300 to U+037F), as some letters are only in lower case."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


def words(text: str) -> list[str]:
    """The pre-tokenizer's words of a text without special tokens."""
    text = unicodedata.normalize("NFC", text)
    lowered = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # by character: no final sigma
    return regex.findall(PATTERN, lowered)


class Counter:
    def __init__(self, tokenizer_json: str):
        self.automaton = load(tokenizer_json)
        self.known = Recent(CACHED, self._chunk)
        self.same: dict[int, int] = {}  # one object for each number that occurs

    def _chunk(self, chunk: bytes) -> int:
        found = words(chunk.decode("utf-8", "replace"))
        both = len(found) << 32 | sum(self.automaton.count(closed(w.encode())) for w in found)
        return self.same.setdefault(both, both) if len(self.same) < 4096 else both

    def texts(self, texts: list[bytes | None]) -> list[tuple[int, int]]:
        """Words and pieces of each. Chunks between ASCII white space share no word."""
        split = [lowered(t or b"").split() for t in texts]
        get = self.known.lookup()
        sums = [sum(map(get, chunks)) for chunks in split]
        return [(s >> 32, s & 0xFFFFFFFF) for s in sums]


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs without text, with n_words and n_tokens (long)."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_tokens")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("n_words", LongType()), StructField("n_tokens", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(sent.value.encode())
        if key not in _workers:
            _workers[key] = Counter(sent.value)
        counter = _workers[key]
        for batch in (whole.slice(i, 128) for whole in batches for i in range(0, whole.num_rows, 128)):
            both = counter.texts(batch.column("__text").to_pylist())
            new = [pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "n_words", "n_tokens"])

    return docs.select(*kept, F.col("text").cast("binary").alias("__text")).mapInArrow(count, schema)
