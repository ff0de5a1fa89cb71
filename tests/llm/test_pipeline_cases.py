"""Every stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from vecpress.llm import common, queries

EXTRA = ["lang_pred", "score", "held_out", "n_lines", "n_dropped", "kept_sha256", "fingerprint", "component_id", "fp", "bands", "key", "row", "h", "u", "keys", "held", "item_id", "piece", "length", "sequence_id", "offset", "pos", "m"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LINE = "A line that is long enough to be counted by the stage. "
STAGES = dict(corpus_pipeline.STAGES)
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "another text under the same id with some words in it"), (2, None), (3, ""), (None, "x y z")]


def _rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    rows = [(0, None), (1, ""), (2, "  \n\t"), (3, "12 !!"), (4, base), (5, base), (5, base), (6, base + " end"), (7, prose(40_000)), (8, "x" * 300_000), (None, base), (None, None), (None, "alone " + prose(30))]
    rows += [(20 + i, f"{prose(30)}\n  {LINE.upper() if i % 2 else LINE}\nend {i}") for i in range(7)] + [(20, f"another text {prose(20)}\n{LINE}")]
    rows += [(40, f"{prose(300)} {ITEMS[0][1]} {prose(300)}"), (40, prose(50)), (41, ITEMS[1][1].upper()), (None, ITEMS[0][1]), (42, "one two three"), (43, "é" * 5000), (44, prose(60) + "<|endoftext|>" + prose(60))]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en" if i % 4 else None, "s", len(t or ""), *EXTRA) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    _frame(spark, _rows()).write.parquet(f"{path}/documents.parquet")
    return path


def _got(frame, stage):
    out = frame.collect()
    assert frame.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), stage
    assert all(r[c] == c for r in out for c in EXTRA)
    return sorted(((r["doc_id"], r["text"]) for r in out), key=repr)


def _lettered(rows):
    return [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]


def _lines(rows):
    return [(d, k[2]) for (d, _), k in zip(rows, brute.line_dedup(rows), strict=True)]


def _first_of_groups(rows):
    """Row numbers that stay."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (brute.words(t) for _, t in rows)]
    root = brute.components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return [i for i, (d, _) in enumerate(rows) if d is None or least[root[i]] == d]


def _clean(rows):
    items = [(i, t) for i, (n, t) in enumerate(ITEMS) if n is not None]
    return [(d, t) for d, t in rows if d is None or not brute.contained([(d, t)], items)]


def test_language_stage(spark, sf_dir):
    got = _got(STAGES["language_id"](spark, _frame(spark, _rows()), sf_dir), "language_id")
    assert got == sorted(_lettered(_rows()), key=repr)


def test_line_stage(spark, sf_dir):
    frame = STAGES["line_dedup"](spark, _frame(spark, _rows()), sf_dir)
    assert _got(frame, "line_dedup") == sorted(_lines(_rows()), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in frame.collect())


def test_near_copy_stage(spark, sf_dir):
    got = _got(STAGES["near_dedup"](spark, _frame(spark, _rows()), sf_dir), "near_dedup")
    stay = [_rows()[i] for i in _first_of_groups(_rows())]
    assert Counter(d for d, _ in got) == Counter({d: 1 for d, _ in stay if d is not None}) + Counter({None: sum(d is None for d, _ in stay)})
    assert set(got) <= set(stay)


def test_decontamination_stage(spark, sf_dir):
    frame = _frame(spark, _rows())
    assert _got(STAGES["decontamination"](spark, frame, sf_dir), "decontamination") == sorted(_clean(_rows()), key=repr)


def test_packing_stage(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = STAGES["best_fit_packing"](spark, _frame(spark, _rows()), sf_dir).collect()
    want = sorted(((d, *p) for d, t in _rows() for p in brute.pieces(tokenizer, t)), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == want


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = _frame(spark, _rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
        assert name == "best_fit_packing" or out.columns == empty.columns


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    before = common.written()
    packed = corpus_pipeline.run(spark, sf_dir)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.written() - before}
    assert left == {"decontamination", "pieces", "firsts"}
    kept = _lines(_lettered(_rows()))
    kept = _clean([kept[i] for i in _first_of_groups(kept)])
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in kept}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
