"""A stream that trains itself: batches, restarts, ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.functions.arrays import vectors
from vecpress.operators import allocation, codecs
from vecpress.sources import datasets
from vecpress.streaming import sweep


def rows_of(n=400):
    return np.random.default_rng(0).standard_normal((n, 12))


def batch(spark, a, b):
    return datasets.from_matrix(spark, rows_of()[a:b]).withColumn("vec_id", F.col("vec_id") + a)


def expected(first, seen=400):
    """Error of rows under a codec of the first ones."""
    codec = codecs.Scalar(4).fit_rows(rows_of()[:first])
    x = rows_of()[:seen]
    return ((x - codec._decode(codec._encode(x))) ** 2).sum(1).mean()


def test_batches_wait_for_the_codec(spark, tmp_path):
    own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 150)
    own.batch(batch(spark, 0, 100), 0)
    assert own.fitted() is None and own.distortion().head()["n"] == 0
    own.batch(batch(spark, 100, 200), 1)
    own.batch(batch(spark, 200, 400), 2)
    got = own.distortion().head()
    assert got["n"] == 400 and abs(got["distortion"] - expected(150)) < 1e-9
    codes = {r["vec_id"]: bytes(r["code"]) for r in own.codes().collect()}
    want = codecs.Scalar(4).fit_rows(rows_of()[:150])._encode(rows_of())
    assert codes == {i: want[i].tobytes() for i in range(400)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    sweep.TrainedStream(spark, folder, codecs.Scalar(4), 100).batch(batch(spark, 0, 150), 0)
    again = sweep.TrainedStream(spark, folder, codecs.Scalar(4), 100)  # after a restart
    again.batch(batch(spark, 0, 150), 0)
    again.batch(batch(spark, 150, 400), 1)
    again.batch(batch(spark, 150, 400), 1)
    got = again.distortion().head()
    assert got["n"] == 400 and abs(got["distortion"] - expected(100)) < 1e-9 and again.codes().count() == 400


def test_killed_between_the_codec_and_the_codes(spark, tmp_path, monkeypatch):
    own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 100)
    own.batch(batch(spark, 0, 60), 0)
    monkeypatch.setattr(own, "_encode", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        own.batch(batch(spark, 60, 200), 1)
    own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 100)
    assert own.fitted() is not None
    own.batch(batch(spark, 60, 200), 1)
    own.batch(batch(spark, 200, 400), 2)
    got = own.distortion().head()
    assert got["n"] == 400 and abs(got["distortion"] - expected(100)) < 1e-9


def test_a_stream_of_files_restarts_where_it_was(spark, tmp_path):
    for i in range(4):
        batch(spark, 100 * i, 100 * i + 100).withColumnRenamed("v", "embedding").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 1:
            own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 50)
            own.run(sweep.stream_vectors(spark, str(tmp_path / "in")), f"file://{tmp_path}/ck")
            assert own.distortion().head()["n"] == 200
    own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 50)
    own.run(sweep.stream_vectors(spark, str(tmp_path / "in")), f"file://{tmp_path}/ck", max_batches=3)
    got = own.distortion().head()
    assert got["n"] == 300 and vectors(spark.read.parquet(str(tmp_path / "in"))).count() == 400


def test_a_short_stream(spark, tmp_path):
    own = sweep.TrainedStream(spark, f"file://{tmp_path}/t", codecs.Scalar(4), 1000)
    own.finish()
    assert own.distortion().head()["distortion"] is None and own.codes().count() == 0
    own.batch(batch(spark, 0, 80), 0)
    own.finish()
    got = own.distortion().head()
    assert got["n"] == 80 and abs(got["distortion"] - expected(80, 80)) < 1e-9
    with pytest.raises(ValueError):
        sweep.TrainedStream(spark, "x", codecs.Scalar(4), 0)


def test_the_programme_beats_greedy_on_measured_costs(spark):
    x = datasets.from_matrix(spark, rows_of() * np.linspace(3, 0.3, 12)).repartition(3)
    costs = allocation.scalar_costs(x)
    assert (costs[:, 1] > costs[:, 0]).any()  # one bit is worse than none
    greedy, best = (allocation.rescore(f(costs, 24), costs) for f in (allocation.empirical, allocation.optimal))
    assert best < greedy and allocation.optimal(costs, 24).sum() <= 24


def test_a_configured_study(spark, tmp_path):
    """Batch size and error sample of a configuration take effect."""
    from vecpress.plans import study
    from vecpress.sources import fvecs

    (tmp_path / "base.fvecs").write_bytes(fvecs.dump(rows_of().astype(np.float32)))
    (tmp_path / "q.fvecs").write_bytes(fvecs.dump(rows_of(30).astype(np.float32)))
    (tmp_path / "c.yaml").write_text(f"dataset:\n  name: tiny\n  base_fvecs: {tmp_path}/base.fvecs\n  query_fvecs: {tmp_path}/q.fvecs\n  n_queries: 7\nmethods: [sq, lvq]\nbpd: [4]\nks: [1, 5]\nchunk_size: 32\nmse_sample: 40\noutput_dir: {tmp_path}/out\n")
    config, seen = datasets.load_config(str(tmp_path / "c.yaml")), []
    drawn = study.kmeans.drawn
    study.kmeans.drawn = lambda x, most, rows=None: seen.append((most, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or drawn(x, most, rows)
    try:
        got = {r["method"]: r for r in study.run_config(spark, config).collect()}
    finally:
        study.kmeans.drawn = drawn
    assert (40, "32") in seen and set(got) == {"sq", "lvq"} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "32"
    whole = study.run_study(datasets.from_matrix(spark, rows_of().astype(np.float32)), datasets.as_queries(datasets.from_matrix(spark, rows_of(30).astype(np.float32)).where("vec_id < 7")), ["sq"], [4], [1, 5]).head()
    assert got["sq"]["n_queries"] == 7 and got["sq"]["recall_at_5"] == whole["recall_at_5"] and got["sq"]["n_db"] == 400
    assert got["sq"]["mse"] != whole["mse"] and 0.5 < got["sq"]["mse"] / whole["mse"] < 2
    assert study.run_config(spark, config).count() == 2  # found finished


def test_a_failed_bench_says_why(spark, monkeypatch):
    from vecpress.plans import study

    x = datasets.from_matrix(spark, rows_of(100))
    monkeypatch.setattr(study, "index_methods", lambda *a: {"broken": lambda *b: 1 / 0})
    got = study.compare(x, datasets.as_queries(x.where("vec_id < 3")), ["broken", "unknown"], 4, 5).collect()
    assert len(got) == 1 and got[0]["recall_at_k"] is None and "ZeroDivisionError" in got[0]["error"]
