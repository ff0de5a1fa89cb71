"""The whole pipeline against plain versions, near copies by the Jaccard similarity of the stage's definition."""

import brute
import corpus_pipeline
from vecpress.llm import queries


def _shingles(text):
    words = brute.re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset([()])


def _alike(a, b):
    shared = len(a & b)
    return shared >= 0.8 * (len(a) + len(b) - shared)


def test_pipeline_equals_plain_stages(spark, data):
    from tokenizers import Tokenizer

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    rows = {d: k[2] for d, k in zip(rows, brute.line_dedup(list(rows.items())), strict=True)}
    sets = {d: _shingles(t) for d, t in rows.items()}
    group = {d: d for d in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and group[a] != group[b] and _alike(sets[a], sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert len(set(group.values())) < len(rows)
    rows = {d: t for d, t in rows.items() if group[d] == d}
    bad = {d for d, _ in brute.contained(list(rows.items()), items)}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((d, *p) for d, t in rows.items() if d not in bad for p in brute.pieces(tokenizer, t))
    packed = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
