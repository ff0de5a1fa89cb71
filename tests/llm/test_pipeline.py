import brute
import corpus_pipeline
from vecpress.llm import queries


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def after(stage, frame):
        return dict(corpus_pipeline.STAGES)[stage](spark, frame, data)

    step = after("language_id", docs)
    assert step.columns == columns
    rows = {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"]: r["text"] for r in step.collect()} == rows

    step = after("line_dedup", step)
    assert step.columns == columns
    kept = brute.line_dedup(list(rows.items()))
    rows = {d: k[2] for d, k in zip(rows, kept, strict=True)}
    assert {r["doc_id"]: r["text"] for r in step.collect()} == rows

    step = after("near_dedup", step)
    assert step.columns == columns
    first = brute.similar_groups(rows)
    rows = {d: t for d, t in rows.items() if first[d] == d}
    assert {r["doc_id"]: r["text"] for r in step.collect()} == rows

    step = after("decontamination", step)
    assert step.columns == columns
    bad = {d for d, _ in brute.contained(list(rows.items()), items)}
    rows = {d: t for d, t in rows.items() if d not in bad}
    assert {r["doc_id"]: r["text"] for r in step.collect()} == rows

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((d, *p) for d, t in rows.items() for p in brute.pieces(tokenizer, t))
    packed = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    room = {}
    for r in packed:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 4096 and len(room) == brute.best_fit([r["length"] for r in packed], 4096)
