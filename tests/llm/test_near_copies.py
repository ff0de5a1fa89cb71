import hashlib
import random

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from vecpress.llm import near_copies, queries


def _shingles(text):
    ws = brute.words(text)
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))


def _kept(rows):
    """Documents that stay when those linked at 0.8 or more leave one of each group."""
    sets = {d: _shingles(t) for d, t in rows}
    roots = brute.components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return {d for d in sets if roots[d] == d}


def _planted():
    """Prose with near copies of one and of several replaced words, some above 0.8 and some below."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for group in range(80):
        text = rng.choices(vocabulary, k=rng.choice([40, 112, 300, 900]))
        rows.append((1000 + 10 * group, " ".join(text)))
        for i in range(1, 4):
            copy = list(text)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * i // 110)):
                copy[at] = rng.choice(vocabulary)
            rows.append((1000 + 10 * group + i, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, held", [(2048, 1024), (2, 1024), (2, 1)])
def test_near_copies_from_eight_tenths_leave_one(spark, monkeypatch, block, held):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "ACTIVE", held)
    rows = _planted()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert stage.columns == docs.columns
    got = [r["doc_id"] for r in stage.collect()]
    assert len(got) == len(set(got)) and set(got) == _kept(rows)
    assert len(got) < len(rows) - 80


def test_fingerprints_alone_link_close_copies(spark, monkeypatch):
    """Without bands the pigeonring index finds close copies, and the exact check still decides."""

    def no_bands(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["fp", "key"])

    monkeypatch.setattr(near_copies, "_members", no_bands)
    rng = random.Random(21)
    rows = []
    for group in range(20):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(900)]
        rows += [(10 * group, " ".join(words)), (10 * group + 1, " ".join([*words, "more"])), (10 * group + 2, " ".join(["some", *words[1:]]))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted(_kept(rows)) == [10 * g for g in range(20)]
    strict = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.9999)
    assert strict.count() == len(rows)


def _units():
    """Sets of several units: chains, stars whose middle alone holds them together, copies, strangers."""
    rng = np.random.default_rng(3)
    chain = [range(i * 5, i * 5 + 100) for i in range(40)]
    middle = set(range(100_000, 100_200))
    star = [middle] + [middle - set(rng.choice(sorted(middle), 20, replace=False)) | set(range(200_000 + 100 * i, 200_010 + 100 * i)) for i in range(40)]
    strangers = [range(300_000 + 1000 * i, 300_050 + 1000 * i) for i in range(15)]
    units = [chain, star, strangers, chain[:20] + [[*x, 10**7] for x in chain[:20]], [*strangers, *chain[10:20], *star[:9]]]
    return [[np.array(sorted(x), np.uint64) for x in unit] for unit in units]


@pytest.mark.parametrize("held, strip, size", [(1024, 1 << 25, 1 << 26), (5, 1 << 25, 4000), (7, 3000, 1 << 26), (1, 1, 900)])
def test_units_in_rounds_lose_no_group(spark, monkeypatch, held, strip, size):
    for name, value in (("ACTIVE", held), ("STRIP", strip), ("STREAM", size)):
        monkeypatch.setattr(near_copies, name, value)
    units, rows, members = _units(), {}, []
    for key, unit in enumerate(units):
        for own in unit:
            fp = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=7).digest())
            rows[fp] = own
            members.append((key, fp, own.nbytes))
    sets = spark.createDataFrame([(fp, own.nbytes, own.tobytes()) for fp, own in rows.items()], "fp long, size long, own binary")
    found = near_copies._rounds(spark.createDataFrame(members, "key long, fp long, size long"), sets, 0.8)
    got = brute.components(rows, lambda a, b, pairs={(min(r), max(r)) for f in found for r in map(tuple, f.collect())}: (min(a, b), max(a, b)) in pairs)
    joint = {(min(a, b), max(a, b)) for unit in range(len(units)) for a in [m[1] for m in members if m[0] == unit] for b in [m[1] for m in members if m[0] == unit]}
    want = brute.components(rows, lambda a, b: (min(a, b), max(a, b)) in joint and near_copies.similar(rows[a], rows[b]))
    assert got == want


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(60)))
    rows = [(7, text), (7, text), (9, text + " end"), (None, text), (None, None), (8, "else")]
    got = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, ""), (0, text), (7, text), (8, "else")]


def test_stages_after_near_copies_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs if any(c.isalpha() for c in r["text"] or "")]
    rows = {d: k[2] for (d, _), k in zip(rows, brute.line_dedup(rows), strict=True)}
    kept = _kept(list(rows.items()))
    rows = {d: t for d, t in rows.items() if d in kept}
    bad = {d for d, _ in brute.contained(list(rows.items()), items)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((d, *p) for d, t in rows.items() if d not in bad for p in brute.pieces(tokenizer, t))
    packed = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
