import random
import zlib

import numpy as np
import pytest

from vecpress.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double, passages string, toxic int"
LABELS = "doc_id long, quality int, toxic int, score double"
INSULTS = ["idiot", "moron", "scum", "worthless", "clown"]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


def corpus(seed=3, n=900):
    """Prose; one text in six has insults, four in the same few words of some of them."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(INSULTS).upper() if j % 2 else "you" for j in range(6)]
        rows.append((i, " ".join(words)))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, None, 0.5, "own", 1) for d, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(d, 1, y, 0.1) for d, y in labels], LABELS)


def brute_segments(scores):
    """By definition: the best segment, first and shortest of ties, then left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = (0.0, 0, 0)
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best[0]:
                best = (total, a, b + 1)
    s, a, b = best
    return brute_segments(scores[:a]) + [(s, a, b)] + [(x, p + b, q + b) for x, p, q in brute_segments(scores[b:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_by_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 64 for _ in range(rng.randint(0, 60))]
    got, whole = toxicity.Segments(), toxicity.segments(np.array(scores))
    cut = rng.randrange(len(scores) + 1)
    got.feed(np.array(scores[:cut]))
    got.feed(np.array(scores[cut:]))
    want = brute_segments(scores)
    for found in (got.found(), whole):
        # cut in the middle of a positive run a segment may be met in two steps, with the same ends
        assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in want] and np.allclose([s for s, *_ in found], [s for s, *_ in want])


def test_held_out_texts_and_passages(spark):
    rows, labels = corpus()
    docs, marked = frames(spark, rows, labels)
    texts = dict(rows)
    got = {r["doc_id"]: r for r in toxicity.score(docs, marked, ["doc_id", "lang"]).collect()}
    assert len(got) == len(rows)
    wrong = [d for d in got if (got[d]["score"] >= toxicity.TOXIC) != (d % 6 == 0)]
    assert len([d for d in wrong if held(d)]) <= 3 and all(0 <= r["score"] <= 1 for r in got.values())
    hits = sum(any(w.upper() in texts[d][p["start"] : p["end"]] for p in got[d]["passages"] for w in INSULTS) for d in got if d % 6 == 0)
    assert hits >= 0.95 * len(rows) / 6


def test_digest_and_hard_cases(spark):
    rows, labels = corpus(4, 600)
    long = " ".join(t for _, t in rows if t) * 2
    clean = " ".join(t for d, t in rows if d % 6)
    rows += [(1000, None), (1001, ""), (1002, "12 !! \n"), (1003, long), (None, rows[0][1]), (0, rows[0][1]), (1004, "z" * 5000), (1005, clean)]
    labels += [(None, 1), (1000, 1), (3, None), (0, 0), (0, 1), (77777, 1)]
    docs, marked = frames(spark, rows, labels)
    out = toxicity.digest(docs, marked)
    assert [(c, t) for c, t in out.dtypes[:4]] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    of = {r["doc_id"]: r for r in got}
    assert all(of[d]["score"] == 0 for d in (1000, 1001, 1002)) and of[1003]["predicted"] == 1 and of[1005]["predicted"] == 0
    assert len({r["score"] for r in got if r["doc_id"] in (0, None)}) == 1


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(5, 400)
    turned = [(d, 1 - y if held(d) else y) for d, y in labels]
    a, b = (sorted(map(tuple, toxicity.digest(*frames(spark, rows, x)).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(0, 1), (2, 1), (3, 1)], [(0, 0), (3, 0)], [(1, None)]])
def test_labels_of_one_class(spark, labels):
    rows, _ = corpus(6, 8)
    got = toxicity.digest(*frames(spark, rows, labels)).collect()
    assert len(got) == 8 and {r["score"] for r in got} == {0.0}


def test_empty_tables(spark):
    docs, marked = frames(spark, [(0, "x")], [(0, 1)])
    assert toxicity.digest(docs.limit(0), marked).collect() == []
    assert [r["score"] for r in toxicity.digest(docs, marked.limit(0)).collect()] == [0.0]


def test_copies_count_once(spark):
    """A clean word of one toxic text that is there a thousand times has no odds."""
    rows, labels = corpus(7, 300)
    copy = "remarkable harvest " + rows[0][1]
    ids = [d for d in range(5000, 7000) if not held(d)][:600]
    docs, marked = frames(spark, rows + [(d, copy) for d in ids] + [(8000, "a remarkable harvest of the year")], labels + [(d, 1) for d in ids])
    got = {r["doc_id"]: r["score"] for r in toxicity.digest(docs, marked).collect()}
    assert got[8000] < 0.7


def test_slices_change_nothing(monkeypatch):
    text = "abc déf, ghi\n" * 50 + "x" * 300
    whole = [w for _, p in toxicity.slices(text) for w in toxicity.words(p)]
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert [w for _, p in toxicity.slices(text) for w in toxicity.words(p)] == whole and "".join(p for _, p in toxicity.slices(text)) == text
