import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecpress.llm import chat_format, components, decontamination, language_id, line_dedup, lm_scoring, nearest, packing, queries, sharding, simhash, token_counts

LINE = "This line is long enough to be counted as repeated. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string, score int"


def _nasty():
    """Nulls, empties, repeated rows, near copies, long texts, odd white space, clashing columns."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(300)
    texts = [None, "", "   \t\n ", "x", "One two", "a\nb\n\nc", "12 34 !!", LINE, base, base, base + " tail", base.replace(" ", "\n", 20), prose(30_000)]
    texts += [f"  {LINE.upper() if i % 2 else LINE}\n{prose(40)}\nshort" for i in range(9)]
    texts += [prose(60) for _ in range(15)] + ["end<|endoftext|>START<|startoftext|> <|EndOfText|>", " nbsp word em \x1cfile", "Σίσυφος ΣΑΣ", "ÀÉÎ é ﬁ 漢字 ½ ٣"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(8, base), (20, rows[20][1]), (None, base), (None, None), (13, "another text under the id 13")]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame([(d, t, "en" if i % 3 else None, "s", len(t or ""), "fp", "sz", 1) for i, (d, t) in enumerate(_nasty())], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- sharding ------------------------------------------------------------------------------


def test_sharding_law(spark, nasty, empty):
    got = sharding.shard(nasty, shards=4)
    assert {"source", "lang", "text"} <= set(got.columns)
    rows = got.select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(rows) == len(_nasty())
    slots = defaultdict(list)
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.digest(empty).count() == 0


def test_shards_are_even_and_keep_equal_texts(spark):
    rng = random.Random(1)
    texts = ["copy " * 40] * 1500 + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 800))) for _ in range(3000)]
    rows = sharding.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    load, where = Counter(), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert set(load) == set(range(8)) and max(load.values()) < 1.02 * min(load.values())
    # 1500 copies outweigh a shard and are cut; all others stay together
    assert sum(len(s) > 1 for s in where.values()) <= 1


def test_hot_text_is_split(spark):
    rows = sharding.digest(spark.createDataFrame([(i, "same text here") for i in range(2000)], "doc_id long, text string")).collect()
    load = Counter(r["shard"] for r in rows)
    assert len(load) == 8 and max(load.values()) <= 1.1 * min(load.values())


@pytest.mark.parametrize("doc_id", ["own", "null", "same"])
def test_law_holds_with_several_heavy_texts(spark, doc_id):
    rng = random.Random(3)
    texts = [f"heavy text {i} " * 5 for i in range(9) for _ in range(990)]
    texts += ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 150))) for _ in range(1000)]
    name = {"own": lambda i: i, "null": lambda i: None, "same": lambda i: 5}[doc_id]
    rows = sharding.digest(spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(load) == 8 and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_like_rows_are_split(spark):
    rows = sharding.digest(spark.createDataFrame([(None, "same text here")] * 4000, "doc_id long, text string")).collect()
    load = Counter(r["shard"] for r in rows)
    assert len(load) == 8 and max(load.values()) <= 1.1 * min(load.values())


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """With a first sample of a few records nearly all ranges are overfull."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "x" * rng.randint(1, 400)) for i in range(3000)] + [(9000, "y" * 30_000)], "doc_id long, text string")
    plain, taken = sharding._drawn, []

    def first_is_poor(sized, per_byte):
        out = plain(sized, per_byte if taken else per_byte / 300)
        taken.append(len(out))
        return out

    monkeypatch.setattr(sharding, "_drawn", first_is_poor)
    load = Counter()
    for r in sharding.digest(docs).collect():
        load[r["shard"]] += r["size"]
    assert len(taken) > 1 and taken[0] < 200
    assert max(load.values()) < 1.03 * min(load.values())


def test_written_shards(spark, nasty, tmp_path):
    sharding.write_shards(sharding.shard(nasty, shards=2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(_nasty())
    for shard in (0, 1):
        slots = [s for f in sorted((tmp_path / "s" / f"shard={shard}").glob("*.parquet")) for s in spark.read.parquet(str(f)).toPandas()["slot"]]
        assert slots == list(range(len(slots)))


# --- packing -------------------------------------------------------------------------------


def test_pieces_are_the_tokenizers(spark, nasty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pieces(nasty, queries.tokenizer_path(), with_ids=True)
    found = rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32")
    want = sorted(((d, *p) for d, t in _nasty() for p in brute.pieces(tokenizer, t)), key=repr)
    assert found == want
    assert got.where("octet_length(ids) <> 4 * length").count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "A<|ENDOFTEXT|>b", "<|endoftext|>", "<|startoftext|><|endoftext|>x<|endoftext|", "don<|endoftext|>'t e<|startoftext|>\u0301 <|<|endoftext|>|>", "<|endoftext|>\n ab. <|startoftext|>, CD", "<|startoftext|> it's I'LL x's 's,", "##, a., b,, don't. 3.14,", "é, ß. ſ, K, İ, ŉ, ª, µ.", "á, ́x, ²,", "tab\x0bvt \x1c fs \x85 nel   ls", "漢,字. ١٢,"])
def test_chunks_tokenize_as_whole_texts(text):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    coder = packing.ChunkEncoder(Path(path).read_text())
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.encode([text.encode()]) == [want]
    assert coder.encode([text.encode()]) == [want]


def test_odd_words_tokenize_as_the_tokenizer_has_them():
    from pathlib import Path

    from tokenizers import Tokenizer

    rng = random.Random(11)
    marks = "abcdestrvlm'’#.,!?;:-_/~019éßÀÞÿ×÷ªµſİ²½漢\u0301 \t\x01\x7f\x85"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    coder = packing.ChunkEncoder(Path(queries.tokenizer_path()).read_text(encoding="utf-8"))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.encode([t.encode() for t in texts]) == want
    coder.known.rest(10)
    assert len(coder.known.new) == 10
    assert coder.encode([t.encode() for t in texts]) == want


#: Capitals whose composed form exists in lower case only.
NO_CAPITAL = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]


def _marked(rng):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcxyz .,'1Éß"
    return "".join(rng.choice(letters) + rng.choice(["", "", chr(0x300 + rng.randrange(0x45))]) for _ in range(rng.randint(1, 12)))


def test_letters_are_composed_before_they_are_lowered():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), random.Random(9)
    json_text = open(path, encoding="utf-8").read()
    tokenizer, coder, counter = Tokenizer.from_file(path), packing.ChunkEncoder(json_text), token_counts.Counter(json_text)
    texts = NO_CAPITAL + [f"a {t}x B" for t in NO_CAPITAL] + [_marked(rng) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode([t.encode() for t in texts])] == want
    found = [[w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(t))] for t in texts]
    assert [n for n, _ in counter.texts([t.encode() for t in texts])] == list(map(len, found))


def test_packing_is_valid_and_tight(spark, nasty, empty):
    packed = packing.pack_documents(nasty, queries.tokenizer_path(), tokens=256, with_ids=True)
    rows = packed.collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in bins.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == brute.best_fit([r["length"] for r in rows], 256)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert whole == {s: b"".join(p[2] for p in sorted(parts)) for s, parts in bins.items()}
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_over_counts_equals_best_fit_over_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {length: rng.randint(1, 30) for length in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 25)))}
    used, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, each, offset in packing.plan(counts, capacity):
        for i in range(n):
            used[sequence + i // each].append((offset + i % each * length, length))
            ranks[length].append(first + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == brute.best_fit([k for k, n in counts.items() for _ in range(n)], capacity)


# --- language identification -----------------------------------------------------------------


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_id_cases(spark, nasty, empty):
    rows = language_id.identify(nasty, nasty.columns).collect()
    assert len(rows) == len(_nasty())
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    assert language_id.digest(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.digest(unlabelled).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_table_features_equal_convolutions():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (5, 40), dtype=np.uint8)
    net = language_id.train(rows, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=1)
    got = net.features(rows, net.tables(), block=2)
    for j, (w, f, b) in enumerate(zip(language_id.WIDTHS, net.filters, net.bias, strict=True)):
        n = 40 - w + 1
        total = sum(f[k][rows[:, k : k + n]] for k in range(w)) + b
        assert np.allclose(got[:, j * 16 : (j + 1) * 16], np.maximum(total.max(1), 0), atol=1e-4)


# --- n-gram scores -----------------------------------------------------------------------------


def _backoff(rows, least):
    texts = [brute.words(t) for _, t in rows]
    ones = Counter(w for t in texts for w in t)
    twos = Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    n = sum(ones.values())
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        s = sum(math.log(ones[w] / n) if i == 0 else math.log(twos[t[i - 1], w] / ones[t[i - 1]]) if twos[t[i - 1], w] >= least else math.log(0.4 * ones[w] / n) for i, w in enumerate(t))
        out.append((doc, len(t), round(s, 3), round(s / len(t), 3) if t else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize(("hot", "pairs", "partition"), [(50_000, 20_000, 6_000_000), (20, 400, 3000), (1, 1, 1000), (2000, 20_000, 500)])
def test_backoff_scores(spark, nasty, empty, monkeypatch, hot, pairs, partition, least):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "PAIRS", pairs)
    monkeypatch.setattr(lm_scoring, "PARTITION", partition)
    monkeypatch.setattr(lm_scoring, "BATCH", 60_000)
    got = sorted(((r[0], r[1], round(r[2], 3), None if r[3] is None else round(r[3], 3)) for r in lm_scoring.score(nasty, min_count=least).collect()), key=repr)
    want = _backoff(_nasty(), least)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002)
    assert lm_scoring.score(empty).count() == 0


def test_every_pair_that_occurs_counts_by_default(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_score"] for r in lm_scoring.score(docs).collect()}
    assert got == {1: pytest.approx(math.log(3 / 6 * 2 / 3)), 2: pytest.approx(math.log(3 / 6 * 1 / 3)), 3: pytest.approx(math.log(3 / 6 * 2 / 3))}


def test_word_counts(spark, nasty):
    want = Counter(w for _, t in _nasty() for w in brute.words(t))
    assert sorted(r["n"] for r in lm_scoring.count_words(nasty).collect()) == sorted(want.values())


# --- nearest neighbours --------------------------------------------------------------------------


def _nearest(vectors, is_query, k):
    usable = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        qv = min((tuple(v) for i, v in usable if i == q), key=lambda v: (len(v), v))
        best = {}
        for i, v in usable:
            if i != q and len(v) == len(qv):
                d = float(nearest.exact_distance(np.array([qv]), v[None])[0])
                best[i] = min(best.get(i, math.inf), d)
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)]
    return out


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    vectors += [(400 + i, vectors[5][1]) for i in range(15)] + [(7, vectors[7][1]), (9, vectors[3][1])]
    vectors += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] + [0.0] * 6), (504, [math.nan] * 8), (505, [math.inf] * 8), (None, vectors[0][1]), (600, [1.0, 2.0]), (700, [2.0, 1.0]), (800, [1e-30] * 8), (900, [1e20] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    rows = nearest.usable(df)
    got = sorted(tuple(r) for r in nearest.search(rows.where("vec_id % 10 = 0"), rows, 10, query_strip=8, candidate_strip=50).collect())
    want = _nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors], lambda i: i % 10 == 0, 10)
    assert got == want
    assert nearest.digest(df.limit(0)).count() == 0


def test_int8_products_are_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-127, 128, (4, 3000)).astype(np.int8), rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (nearest.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


# --- decontamination -------------------------------------------------------------------------


def test_contained_items_equal_brute_force(spark, nasty, empty):
    docs = _nasty()
    long = docs[12][1].split()
    items = [(1, " ".join(long[5000:5012])), (2, " ".join(long[200:260]).upper()), (3, " ".join(long[29_900:30_000])), (4, "x"), (5, "one two"), (6, " ".join(long[100:140] + ["other"] * 30))]
    items += [(7, None), (8, ""), (None, "one two"), (9, docs[25][1]), (10, " ".join(long[7:13])), (11, docs[25][1]), (12, " ".join(long[900:1500])), (12, " ".join(long[900:1500]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.contained(nasty, table).collect()}
    named = [(d, t) for d, t in docs if d is not None]
    assert got == brute.contained(named, [(i, t) for i, t in items if i is not None])
    kept = decontamination.decontaminate(nasty, table)
    named_items = [(i, t) for i, t in items if i is not None]
    assert kept.columns == nasty.columns and kept.count() == sum(d is None or not brute.contained([(d, t)], named_items) for d, t in docs)
    assert decontamination.contained(empty, table).count() == 0
    assert decontamination.contained(nasty, table.limit(0)).count() == 0


def test_a_shingle_that_all_share(spark):
    """One passage stands in every document and every item; only the items' own texts decide."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = "all rights reserved by the author"
    items = [(i, f"{prose(30)} {shared} {prose(30)}") for i in range(40)] + [(100, shared)]
    docs = [(i, f"{prose(200)} {shared} {prose(100)}" + (f" {items[i][1]}" if i < 5 else "")) for i in range(60)]
    got = decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted([(i, i) for i in range(5)] + [(i, 100) for i in range(60)])


def test_texts_under_one_item_id_are_items_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words[:15]), " ".join(words[20:35])
    table = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, " ".join([*words[:9], "x", *words[20:29]])), (3, one + " and " + two), (4, two), (5, " ".join(words[:9])), (5, " ".join(words[5:15])), (6, one), (6, "clean"), (None, one)], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontamination.contained(docs, table).collect())
    assert got == [(1, 1, 11, 11, 1.0), (1, 2, 11, 11, 1.0), (3, 1, 11, 11, 1.0), (3, 1, 11, 11, 1.0), (3, 2, 11, 11, 1.0), (4, 1, 11, 11, 1.0), (6, 1, 11, 11, 1.0), (6, 2, 11, 11, 1.0)]
    kept = decontamination.decontaminate(docs, table).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in kept) == [(0, 15), (2, 19), (5, 9), (5, 10), (6, 1)]


def test_bit_tables_grow_with_the_items():
    assert decontamination.table_bits(0) == decontamination.LEAST_BITS
    assert decontamination.table_bits(1_000_000) >= 16_000_000
    assert decontamination.table_bits(10**9) == decontamination.MOST_BITS


def test_planted_items_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 150)))) for i in range(60)]
    docs = []
    for i, text in items:
        around = [rng.choice(words) for _ in range(rng.choice([0, 50, 3000]))]
        cut = rng.randint(0, len(around))
        docs.append((i, " ".join([*around[:cut], text, *around[cut:]])))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(400))) for i in range(100)]
    got = {(r[0], r[1]) for r in decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    assert got == {(i, i) for i, _ in items}


def test_segments_of_long_texts_miss_no_window(monkeypatch):
    h = np.random.default_rng(2).integers(1, 1 << 63, 5000, np.uint64)
    whole = decontamination.window_keys(h, [5, 6], lambda k: k)
    monkeypatch.setattr(decontamination, "SEGMENT", 64)
    assert set(whole.tolist()) <= set(decontamination.window_keys(h, [5, 6], lambda k: k).tolist())


# --- line dedup -------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, nasty, empty):
    out = line_dedup.dedup_lines(nasty)
    assert set(nasty.columns) < set(out.columns)
    want = brute.line_dedup(_nasty())
    got = rows_of(out, "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(((d, *w) for (d, _), w in zip(_nasty(), want, strict=True)), key=repr)
    digest = rows_of(line_dedup.digest(nasty), "doc_id", "kept_sha256")
    assert digest == sorted(((d, hashlib.sha256(w[2].encode()).hexdigest()) for (d, _), w in zip(_nasty(), want, strict=True)), key=repr)
    assert line_dedup.digest(empty).count() == 0


# --- simhash ---------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark, nasty, empty):
    rows = [(d, t) for d, t in _nasty() if d is not None]
    byid = {}
    got = simhash.link(nasty).where("doc_id is not null").select("doc_id", "text", "fingerprint", "component_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{brute.simhash(r['text']):016x}"
        byid.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in byid.values())
    prints = {brute.simhash(t) for _, t in rows}
    roots = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, t in rows:
        root = roots[brute.simhash(t)]
        least[root] = min(least.get(root, d), d)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, least[roots[brute.simhash(t)]]) for d, t in rows}
    assert simhash.digest(empty).count() == 0
    clash = simhash.link(nasty.withColumn("fp", F.lit("mine")))
    assert set(clash.columns) == {*nasty.columns, "fp", "component_id"} and clash.select("fp").distinct().collect()[0][0] == "mine"


def test_links_lose_none_within_three_bits(spark, monkeypatch):
    rng = random.Random(6)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for block in (4096, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = components.components(simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")))
        roots = {r["u"]: r["v"] for r in found.collect()}
        want = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
        groups = defaultdict(set)
        for x in fps:
            groups[roots.get(signed(x), signed(x))].add(x)
        expected = defaultdict(set)
        for x in fps:
            expected[want[x]].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_first_leaves_one_of_each_group(spark, nasty):
    kept = simhash.keep_first(nasty)
    assert kept.columns == nasty.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    roots = brute.near_copies([(i, t) for i, (d, t) in enumerate(_nasty())])
    named = [d for d, _ in _nasty() if d is not None]
    assert len(ids) == len([i for i in ids if i is None]) + len({i for i in ids if i is not None})
    assert ids.count(None) == 2 and set(ids) - {None} <= set(named)
    assert {0, 8, 12} <= set(ids) and not {1, 2, 9} & set(ids)
    assert len(roots) == len(_nasty())


def test_components_of_stars_and_rings(spark):
    rng = random.Random(2)
    links = [(7, i) for i in range(100, 400)] + [(i, 2) for i in range(100, 130)] + [(1000 + i, 1000 + (i + 1) % 40) for i in range(40)] + [(5000 - i, 4999 - i) for i in range(30)]
    rng.shuffle(links)
    nodes = {n for p in links for n in p}
    both = set(links) | {(b, a) for a, b in links}
    want = brute.components(nodes, lambda a, b: (a, b) in both)
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_chains(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1000)], "a long, b long").repartition(5)
    got = {r["u"]: r["v"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


# --- chat format -------------------------------------------------------------------------------


def _chats():
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "only"), (3, None, None, "who"), (3, 0, "ann", ""), (None, 1, "zed", "lost")]
    rows += [(4, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(700)] + [(5, 0, "ann", f"same {i:03d}") for i in range(600)] + [(1, 1, "ann", "hi <|end|>")]
    return rows


def _rendered(turns, speaker):
    text, spans = "", []
    for r, x in turns:
        text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == speaker else f"<|user name={r}|>\n"
        if r == speaker:
            spans.append((len(text), len(text) + len(x) + 8))
        text += x + "<|end|>\n"
    return text, spans


def _dialogues(chats):
    by = defaultdict(list)
    for c, t, r, x in chats:
        by[c].append((-1 if t is None else t, r or "unknown", (x or "").replace("<|", "< |")))
    return {(c, s): [(r, x) for _, r, x in sorted(turns)] for c, turns in by.items() for s in {r for _, r, _ in turns if r != "system"}}


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_chat_rotation(spark, partitions):
    chats = _chats() + [(6, t, "ann" if t % 3 else "bob", f"turn {t}") for t in range(250, 260)] + [(None, None, None, "like rows")] * 300
    table = spark.createDataFrame([(*r, "x", 1) for r in chats], "conv_id long, turn int, role string, text string, speaker string, part int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rotated = chat_format.rotate(table)
        got, joined = rotated.collect(), chat_format.join_parts(rotated).collect()
        assert chat_format.rotate(table.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    spans = lambda r: [(m["start"], m["stop"]) for m in r["mask"]]
    want = {}
    for (c, s), turns in _dialogues(chats).items():
        want |= {(c, s, i // 256): (len(turns[i : i + 256]), *_rendered(turns[i : i + 256], s)) for i in range(0, len(turns), 256)}
    assert {(r["conv_id"], r["speaker"], r["part"]): (r["n_turns"], r["text"], spans(r)) for r in got} == want
    assert sum(r["conv_id"] == 6 for r in got) == 2  # ten turns are one row a speaker whatever their numbers
    assert {(r["conv_id"], r["speaker"]): (r["n_turns"], r["text"], spans(r)) for r in joined} == {k: (len(t), *_rendered(t, k[1])) for k, t in _dialogues(chats).items()}


# --- token counts --------------------------------------------------------------------------------


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(8)
    for _ in range(60):
        alphabet = range(3)
        pieces = {(s,) for s in alphabet} | {tuple(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 14))}
        machine = token_counts.Automaton(sorted(pieces))
        for _ in range(40):
            word = [rng.choice(alphabet) for _ in range(rng.randint(0, 30))]
            assert machine.count(word) == brute.greedy_pieces(word, pieces)


def test_token_counts(spark, nasty, empty):
    from pathlib import Path
    import json

    path = queries.tokenizer_path()
    letters = token_counts.byte_letters()
    vocab = {token_counts.symbols(t, letters) for t in json.loads(Path(path).read_text())["model"]["vocab"]}
    rows = [(d, t) for d, t in _nasty() if len(t or "") < 5000]
    want = []
    for d, t in rows:
        found = token_counts.words(t or "")
        want.append((d, len(found), sum(brute.greedy_pieces(token_counts.closed(w.encode()), vocab) for w in found)))
    assert all(n >= w for _, w, n in want)
    got = token_counts.token_counts(nasty, path)
    assert "text" not in got.columns and {"source", "score"} <= set(got.columns)
    short = token_counts.token_counts(nasty.where("text is null or length(text) < 5000"), path)
    assert rows_of(short, "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(empty, path).count() == 0


# --- queries against SQL --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    got = queries.queries()[name](spark, data).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple("None" if v is None or v is pd.NA or v != v else repr(v) for v in r) for r in f.astype(object).itertuples(index=False))
    assert [x.replace(".0'", "'") for x in map(repr, key(got))] == [x.replace(".0'", "'") for x in map(repr, key(want))]
