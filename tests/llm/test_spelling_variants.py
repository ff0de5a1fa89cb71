import random
import re
import zlib
from collections import Counter

import pytest

from vecpress.llm import spelling_variants as variants

SCHEMA = "doc_id long, text string, word string, n int, root string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = (best if best and counts[best] >= 2 * n else None, len(others))
    for w, n in counts.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n, form[w][1], counts[f] if f else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def variants_of(rng, words, n):
    out = []
    for _ in range(n):
        w = rng.choice(words)
        i = rng.randrange(len(w) + 1)
        out.append(rng.choice([w, w, w, w[:i] + rng.choice("aé×zß") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("aéZ") + w[i + 1 :]]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_pairs(spark, seed, monkeypatch):
    """Chains of forms, ties, runs of equal letters, odd letters, nulls, repeats, long texts and words."""
    monkeypatch.setattr(variants, "SLICE", 50)
    monkeypatch.setattr(variants, "HELD", 40)
    monkeypatch.setattr(variants, "KEYS", 64)
    rng = random.Random(seed)
    words = ["hello", "hallo", "hullo", "jello", "aaaaa", "aaaaaa", "éclair", "straße", "Größe", "abcde", "abcdef", "abcdefg", "x" * 300, "x" * 301, "y" + "x" * 299]
    texts = [" ".join(variants_of(rng, words, 120)) for _ in range(12)] + [None, "", "  \n", "12 ab", "tail " * 500, "chaina " * 3 + "chainb " * 9 + "chainbs " * 30]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (None, None), (3, "Hello hello HELLO")]
    frame = spark.createDataFrame([(d, t, "own", 1, "own") for d, t in rows], SCHEMA).repartition(3)
    got = rows_of(variants.group_variants(frame))
    assert got == plain(rows) and any(r[2] != (r[1] or r[0]) for r in got)


def test_empty_table(spark):
    assert rows_of(variants.group_variants(spark.createDataFrame([], SCHEMA))) == []


def test_keys_are_those_of_strings():
    """Groups by key are groups by the wildcard or shortened string itself."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(300)})
    by_key, by_text = {}, {}
    for rows, k1, k2, part in variants.keys(words):
        for r, a, b, p in zip(rows, k1, k2, part, strict=True):
            by_key.setdefault((a, b), set()).add((words[r], "w" if p == variants.REPLACED else "d"))
    for w in words:
        by_text.setdefault(w, set()).add((w, "d"))
        for i in range(len(w)):
            by_text.setdefault(w[:i] + "?" + w[i + 1 :], set()).add((w, "w"))
            if len(w) > variants.LEAST_LENGTH:
                by_text.setdefault(w[:i] + w[i + 1 :], set()).add((w, "d"))
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_text.values()))


def test_slices_end_between_runs(monkeypatch):
    text = "abÀc déf, GHI\n jkl" * 30 + "x" * 90
    whole = [r for part in variants.runs(text.encode()) for r in part]
    monkeypatch.setattr(variants, "SLICE", 5)
    assert [r for part in variants.runs(text.encode()) for r in part] == whole and len(whole) > 100


def test_counts_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(variants, "HELD", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2", None]), pa.array([b"hello world again " * 3, b"hello other words shall count here", None])], names=["d", "t"])
    parts = list(variants._counts(iter([batch])))
    counts = Counter()
    for p in parts:
        for w, n in zip(*(c.to_pylist() for c in p.columns), strict=True):
            counts[w] += n
    assert len(parts) > 1 and counts["hello"] == 4 and all(len(w) >= 5 for w in counts)


def test_a_word_of_many_letters():
    """Rows follow the letters, and their size does not."""
    assert sum(len(r) for r, *_ in variants.keys(["ab" * 5000])) == 1 + 10_000 + 10_000


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_roots_of_chains(spark, n):
    forms = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100 + i, n) for i in range(50)], "id long, form long")
    assert {r["root"] for r in variants.roots(forms).collect()} == {n}
