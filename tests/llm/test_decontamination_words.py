"""Words, their hashes and window minima as arrays, against plain forms."""

import random

import numpy as np
import pytest
from vecpress.llm import decontamination as d

ODD = ["", " ", "a", "_a_b__", "one  two\nthree", "İstanbul ß² ٣٤ _ x", "é é 日本語 x1_2 \U0001d538b", "x" * 9000 + " y", "naïve one naïve two"]


@pytest.mark.parametrize("chars", [1 << 20, 5])
def test_words_are_those_of_tokenize(monkeypatch, chars):
    monkeypatch.setattr(d, "CHARS", chars)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab1 _-éÉ²\n漢") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    hashes = {}
    for text in texts:
        plain, words = d.tokenize(text), d.Words(text)
        assert [words.text[a:b] for a, b in zip(words.starts, words.ends, strict=True)] == plain
        assert [words.shingle(k, 5) for k in range(max(1, len(plain) - 4) if plain else 0)] == d.shingles(plain)
        for word, h in zip(plain, words.hashes.tolist(), strict=True):
            assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes) > 500
    assert len(d.Words(None)) == 0


@pytest.mark.parametrize("sizes", [[4, 5, 6], [4], [6], [5, 8]])
def test_keys_are_the_minima_of_all_windows(sizes):
    for n in (1, 3, 4, 5, 16, 19, 20, 21, 33, 64, 257, 1000):
        h = np.random.default_rng(n).integers(1, 1 << 63, n, np.uint64)
        want = set()
        for s in sizes:
            block, blocks = 1 << (s - 2), -(-n // (1 << (s - 2)))
            for i in range(max(1, blocks - 4)):
                part = h[i * block : (i + 5) * block] if blocks > 4 else h
                want |= {int(d._signed((part * d._ODD[j] + d._ADD[j]).min(keepdims=True), j, s)[0]) for j in range(d.HASHES)}
        assert set(d.window_keys(h, sizes, lambda k: k).tolist()) == want
