"""Searches where rounding, ties, inner products or sizes matter, and what codecs gained around them."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.functions import arrays
from vecpress.operators import codecs, grid, ivf, kmeans, knn, metrics, moments
from vecpress.plans import registry, study
from vecpress.sources import datasets
from vecpress.streaming import sweep


def _rows(rows=600, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((rows, dims)) * np.linspace(3, 0.3, dims)


@pytest.fixture(scope="module")
def x(spark):
    return datasets.from_matrix(spark, _rows()).repartition(4).persist()


@pytest.fixture(scope="module")
def q(x):
    return datasets.as_queries(x.where("vec_id % 30 = 0"))


def _lists(found):
    return {r["qid"]: r["ids"] for r in knn.wide(found).collect()}


@pytest.mark.parametrize("offset", [1e4, 1e6])
def test_offset_vectors_lose_no_neighbour(spark, offset):
    rng = np.random.default_rng(1)
    rows = offset + rng.normal(0, 0.01, (300, 64))
    df = datasets.from_matrix(spark, rows).repartition(3)
    got = _lists(knn.search(df, datasets.as_queries(df), 10))
    for i in range(300):
        d = knn.ordered_sum((rows[i] - rows) ** 2)
        assert got[i] == np.lexsort((np.arange(300), d))[:10].tolist()
    c = rows[:40]
    own, dist = kmeans.nearest(rows, c)
    exact = np.stack([knn.ordered_sum((rows - t) ** 2) for t in c], 1)
    assert (own == exact.argmin(1)).all() and (dist == exact.min(1)).all()


def test_many_queries_stay_in_tiles(spark):
    """20,000 queries against 4,000 rows: one cost matrix of them all would take 640 MB."""
    rng = np.random.default_rng(2)
    rows, queries = rng.standard_normal((4000, 16)), rng.standard_normal((20_000, 16))
    blocks, top = 0, None
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for i in range(0, len(queries), grid.QUERY_ROWS):
        part, blocks = queries[i : i + grid.QUERY_ROWS], blocks + 1
        top = knn.Top(len(part), 5)
        knn.meet(top, "l2", part, np.arange(len(part)), rows, np.arange(4000))
    assert blocks == 2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    for j in (0, 77, 3000):
        d = knn.ordered_sum((queries[grid.QUERY_ROWS + j] - rows) ** 2)
        assert top.ids[j].tolist() == np.lexsort((np.arange(4000), d))[:5].tolist()


def test_wide_matrices_reach_the_driver_as_one_row(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((40, 700))
    mu, cov = moments.mean_cov(datasets.from_matrix(spark, m).repartition(5))
    assert np.allclose(cov, np.cov(m.T, bias=True)) and np.allclose(mu, m.mean(0))
    with pytest.raises(ValueError):
        arrays.reduce_tables(spark.createDataFrame([], "vec_id long, v array<double>"), lambda r: {"n": [len(r)]}, {"n": np.add})


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("make", [codecs.SignBit, lambda metric: codecs.Segmented(4, metric=metric), lambda metric: codecs.Segmented(4, metric=metric, codebook="lloyd")])
def test_estimates_rank_by_their_metric(spark, x, q, make, metric):
    codec = make(metric=metric).fit(x)
    truth = knn.search(x, q, 10, metric)
    args = (0,) if isinstance(codec, codecs.SignBit) else ()
    found = ivf.estimate_search(codec, codec.encode(x), q, 10, *args)
    least = 0.35 if isinstance(codec, codecs.SignBit) else 0.85
    assert metrics.recall_study(truth, found, 10).head()["recall"] >= least
    index = ivf.IVF(6, make(metric=metric), metric, iterations=3).fit(x)
    found = index.search(index.encode(), q, 10, 6, True)
    assert metrics.recall_study(truth, found, 10).head()["recall"] >= least
    scores = [r["score"] for r in found.orderBy("qid", "rk").collect()][:10]
    assert scores == sorted(scores, reverse=metric == "ip")


def test_estimators_need_the_metric_of_the_index(x, q):
    index = ivf.IVF(4, codecs.SignBit("l2"), "ip", iterations=1).fit(x)
    with pytest.raises(ValueError):
        index.search(index.encode(), q, 5, 4, True)


def test_ties_of_estimates_go_to_the_smaller_id(spark):
    rows = np.tile(_rows(4, 16), (50, 1))
    df = datasets.from_matrix(spark, rows).repartition(7)
    codec = codecs.SignBit().fit(df)
    got = _lists(ivf.estimate_search(codec, codec.encode(df), datasets.as_queries(df.where("vec_id < 4")), 6, 0))
    assert got == {i: [i + 4 * j for j in range(6)] for i in range(4)}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_pruned_searches_find_what_whole_ones_do(x, q, metric):
    codec = codecs.Segmented(3, metric=metric, prune=True).fit(x)
    codes = codec.encode(x).persist()
    pruned = ivf.estimate_search(codec, codes, q, 10)
    m = arrays.from_binary(codes.toArrow()["code"].combine_chunks())
    ids = codes.toArrow()["vec_id"].to_numpy()
    queries = {r["qid"]: np.array([r["q"]]) for r in q.collect()}
    for qid, found in _lists(pruned).items():
        cost = codec.estimate(m, queries[qid])[0] * (1 if metric == "l2" else -1)
        assert found == ids[np.lexsort((ids, cost))[:10]].tolist()
    rows = np.array([r["v"] for r in x.orderBy("vec_id").collect()])[ids]
    for qid, v in list(queries.items())[:5]:
        true = ((rows - v) ** 2).sum(1) if metric == "l2" else rows @ v[0]
        bound = codec.bound(m, v)[0]
        assert ((bound <= true + 1e-4) if metric == "l2" else (bound >= true - 1e-4)).all()


@pytest.mark.parametrize("codebook", ["lloyd", "exact"])
def test_learned_levels_of_segments(x, codebook):
    grid, learned = (codecs.Segmented(3, joint=False, codebook=c).fit(x) for c in ("grid", codebook))
    error = lambda c: metrics.mse_per_element(c.reconstruct(x)).head()["mse"]
    assert learned.plan == grid.plan and error(learned) < 1.1 * error(grid)
    assert learned.code_size() == grid.code_size()
    assert study.build("ours_exact", 4, 32).codebook == "exact" and study.build("ours", 4, 32).codebook == "lloyd"


def test_reconstruct_by_id(spark, x):
    codec = codecs.Scalar(8)
    ids = spark.createDataFrame([(5,), (5,), (17,), (99_999,)], "vec_id long")
    with pytest.raises(RuntimeError):
        codec.reconstruct_ids(x.select("vec_id", F.lit(b"").alias("code")), ids)
    codes = codec.fit(x).encode(x)
    got = {r["vec_id"]: r["v"] for r in codec.reconstruct_ids(codes, ids).collect()}
    want = {r["vec_id"]: r["v"] for r in codec.decode(codes).where("vec_id in (5, 17)").collect()}
    assert got == want and len(want) == 2
    with pytest.raises(ValueError):
        codec.reconstruct_ids(codes, spark.createDataFrame([(-1,)], "vec_id long"))


def test_full_results_are_asked_for(x, q):
    assert knn.search(x, q, 600, full=True).groupBy("qid").count().head()["count"] == 600
    with pytest.raises(ValueError):
        knn.search(x, q, 601, full=True)


def test_rotated_codebooks_turn_the_queries(x, q):
    codec = codecs.OptimizedProduct(4, 4, 4, rounds=2).fit(x)
    got = ivf.codebook_query(codec.books, q, 1, rotation=codec.rotation).orderBy("qid", "m").collect()
    rows = np.array([r["q"] for r in q.orderBy("qid").collect()]) @ codec.rotation
    want = np.stack([j * 16 + kmeans.nearest(rows[:, 8 * j : 8 * j + 8], codec.books[j])[0] for j in range(4)], 1)
    assert [r["id"] for r in got] == want.ravel().tolist()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_registered_index_recalls_nine_tenths(spark, sf):
    x = registry._x(spark, f"/root/testdata/sf{sf}")
    q = registry._q(x)
    index = ivf.IVF(registry.CELLS, iterations=3).fit(x)
    truth = knn.search(x, q, 10)
    found = index.search(index.encode(), q, 10, registry.PROBES)
    assert metrics.recall_ivf(truth, found, 10).head()["recall"] >= 0.9


def test_centroids_of_a_bounded_sample_index_every_row(spark):
    df = datasets.from_matrix(spark, _rows(2000, 8)).repartition(4)
    assert 300 < kmeans.drawn(df, 400).count() < 500 and kmeans.drawn(df, 2000).count() == 2000
    index = ivf.IVF(10, rows_per_cell=20, iterations=2).fit(df)
    assert index.encode().count() == 2000


def test_rows_without_ids_are_numbered_by_place(spark, tmp_path):
    rows = [([float(i)],) for i in range(300)]
    spark.createDataFrame(rows, "openai array<double>").repartition(3).write.parquet(str(tmp_path / "t"))
    tables = []
    for size in ("128m", "256"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        tables.append(sorted((r["vec_id"], r["v"][0]) for r in datasets.openai_table(spark, str(tmp_path / "t")).collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tables[0] == tables[1] and [i for i, _ in tables[0]] == list(range(300))


def test_stream_stops_after_its_batches(spark, tmp_path, x):
    for i in range(5):
        x.where(f"vec_id % 5 = {i}").withColumnRenamed("v", "embedding").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    codec = sweep.train_on_first(codecs.Scalar(8), x, 50)
    got = sweep.streaming_distortion(sweep.stream_vectors(spark, str(tmp_path / "in")), codec, str(tmp_path / "ck"), max_batches=2).head()
    assert got["n"] == 240


INDEXED = ["adc_ivfpq_search", "adc_ivfpq_search_ip", "ivf_flat_search", "ivf_flat_search_ip", "ivf_flat_search_strips", "ivf_pq_per_cell_search", "ivf_pq_per_cell_tables", "ivf_saved_search", "ivf_sq_search", "ivfpq_search", "rabitq_ivf_search", "rabitq_ivf_search_ip"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """More rows than 256 for each of the eight cells."""
    rows = _rows(2600, 64, 11)
    path = str(tmp_path_factory.mktemp("large"))
    datasets.from_matrix(spark, rows / np.linalg.norm(rows, axis=1, keepdims=True)).select("vec_id", F.col("v").cast("array<float>").alias("embedding")).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", INDEXED)
def test_indexes_are_fitted_as_their_sql(spark, large, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{large}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, large).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
