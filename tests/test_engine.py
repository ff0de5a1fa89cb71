import json
import os
from datetime import UTC, datetime
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.functions import distance
from vecpress.operators import allocation, bitpack, codecs, grid, ivf, kmeans, knn, metrics, moments, report
from vecpress.plans import registry, study
from vecpress.sources import datasets, fvecs, models, runlog
from vecpress.streaming import sweep


def normal(rows, dims, seed=0, unit=False):
    x = np.random.default_rng(seed).standard_normal((rows, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


def anisotropic(rows=1500, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((rows, dims)) @ (np.diag(np.linspace(4, 0.2, dims)) @ rng.standard_normal((dims, dims)))


@pytest.fixture(scope="module")
def x(spark):
    return datasets.from_matrix(spark, normal(600, 32)).repartition(4).persist()


@pytest.fixture(scope="module")
def skewed(spark):
    return datasets.from_matrix(spark, anisotropic()).repartition(4).persist()


def matrix(df, column="v"):
    return np.array([r[column] for r in df.orderBy("vec_id").collect()])


def error(codec, df):
    both = codec.fit(df).reconstruct(df)
    return metrics.mse_per_element(both).head()[0]


# --- codecs ------------------------------------------------------------------------------


@pytest.mark.parametrize("make", [lambda b: codecs.MultiBit(b), lambda b: codecs.Local(b)])
def test_more_bits_less_error(x, make):
    errors = [error(make(b), x) for b in (2, 4, 8)]
    assert errors[0] > errors[1] > errors[2] and errors[0] < matrix(x).var()
    assert make(2).fit(x).code_size() < make(8).fit(x).code_size()


@pytest.mark.parametrize("codec", [codecs.Scalar(4), codecs.Scalar(8), codecs.Scalar(16), codecs.Product(8, 4, 3), codecs.SignBit(), codecs.MultiBit(3), codecs.Local(5), codecs.Segmented(3)])
def test_decoding_is_by_row_and_sizes_hold(x, codec):
    codec.fit(x)
    codes = codec.encode(x)
    assert {r[0] for r in codes.select(F.octet_length("code")).distinct().collect()} == {codec.code_size()}
    assert codec.compression_ratio() == 4 * 32 / codec.code_size()
    some = codes.where(F.col("vec_id").isin(0, 7, 100, 599))
    assert np.allclose(matrix(codec.decode(some)), matrix(codec.decode(codes))[[0, 7, 100, 599]], rtol=0, atol=1e-12)


def test_scalar_edges(spark):
    with pytest.raises(ValueError):
        codecs.Scalar(5)
    rows = np.array([[0.0, 5, 1], [1, 5, 2], [0.5, 5, 9]])
    codec = codecs.Scalar(4).fit(datasets.from_matrix(spark, rows))
    assert codec.code_size() == 2
    assert np.allclose(codec._decode(codec._encode(rows))[:, 1], 5)
    assert codec.levels(np.array([[-9.0, 5, 99]])).tolist() == [[0, 0, 15]]


def test_product_arguments(x):
    assert codecs.Product(num_chunks=4, num_clusters=16).bits == 4
    for wrong in ({"num_clusters": 12}, {"m": 4, "num_chunks": 16}, {"bits": 4, "num_clusters": 256 * 2}):
        with pytest.raises(ValueError):
            codecs.Product(**wrong)
    with pytest.raises(AssertionError):
        codecs.Product(7, 4).fit(x)


def test_rotation_helps_product_codes(skewed):
    assert error(codecs.OptimizedProduct(8, 4, 5, 3), skewed) <= 1.02 * error(codecs.Product(8, 4, 5), skewed)


def test_constant_and_mean_rows(spark):
    rows = np.concatenate([normal(50, 8), np.zeros((1, 8))])
    rows[-1] = rows[:-1].mean(0)
    df = datasets.from_matrix(spark, rows)
    for codec in (codecs.Local(4), codecs.SignBit(), codecs.MultiBit(4), codecs.Segmented(4, block=4)):
        assert np.isfinite(matrix(codec.fit(df).decode(codec.encode(df)))).all()


def test_rank_aware(skewed):
    head = [allocation.rank_aware(moments.pca(skewed)[2], 3, a)[:4].sum() for a in (0.0, 0.5, 2.0)]
    assert head[0] <= head[1] <= head[2]
    dense = codecs.RankAware(3, 0.5, packing="dense", codebook="lloyd").fit(skewed)
    whole = codecs.RankAware(3, 0.5, packing="ffd", codebook="lloyd").fit(skewed)
    rows = matrix(skewed)
    assert np.array_equal(dense._decode(dense._encode(rows)), whole._decode(whole._encode(rows)))
    assert dense.code_size() <= whole.code_size() <= 32
    assert error(codecs.RankAware(3, 0.0), skewed) <= error(codecs.RankAware(3, 2.0), skewed)
    assert error(codecs.RankAware(3, 0.0, codebook="exact"), skewed) < error(codecs.RankAware(3, 0.0, codebook="gaussian"), skewed) * 1.05


def test_segmented(skewed):
    for joint in (True, False):
        assert error(codecs.Segmented(2, joint), skewed) > error(codecs.Segmented(6, joint), skewed)
    o = normal(40, 16)
    for bits in (1, 3, 6):
        first = codecs.grid_codes(o, bits)
        moved = codecs.adjust(o, first, bits, 6)

        def cosine(codes, bits=bits):
            p = codecs.grid(codes, bits)
            return (o * p).sum(1) / np.linalg.norm(p, axis=1)

        assert (cosine(moved) >= cosine(first) - 1e-12).all()
    assert codecs.grid_codes(np.zeros((1, 4)), 3).tolist() == [[0] * 4]
    assert codecs.downsample(np.array([7, 4, 0]), 3, 1).tolist() == [1, 1, 0]


def test_estimates_are_near_distances(skewed):
    rows, q = matrix(skewed), anisotropic(5, seed=0)
    codec = codecs.Segmented(7).fit(skewed)
    exact = ((q[:, None] - rows[None]) ** 2).sum(2)
    assert np.abs(codec.estimate(codec._encode(rows), q) - exact).max() < 0.05 * exact.max()
    sign = codecs.SignBit().fit(skewed)
    assert np.corrcoef(sign.estimate(sign._encode(rows), q).ravel(), exact.ravel())[0, 1] > 0.9


# --- training, allocation, packing -----------------------------------------------------------


def test_moments(skewed):
    rows = matrix(skewed)
    mu, cov = moments.mean_cov(skewed)
    assert np.allclose(mu, rows.mean(0)) and np.allclose(cov, np.cov(rows.T, ddof=0))
    _, axes, var = moments.pca(skewed)
    assert np.allclose(axes.T @ axes, np.eye(32)) and (np.diff(var) <= 1e-9).all()
    turn = moments.random_rotation(16, 3)
    assert np.allclose(turn @ turn.T, np.eye(16))
    with pytest.raises(ValueError):
        moments.mean(skewed.limit(0))


def test_exact_one_dimensional_means():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = np.sort(rng.normal(size=9))
        for k in (1, 2, 3, 4):
            best = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(v, cut)) for cut in combinations(range(1, 9), k - 1))
            c = kmeans.exact_1d(v, [k])[k]
            assert np.isclose(((v - c[kmeans.levels_of(v, c)]) ** 2).sum(), best)
    assert kmeans.exact_1d(np.array([1.0, 1, 2]), [8])[8].tolist() == [1, 2]
    points = np.array([-0.99, 0, 0.99, 2])
    c = kmeans.exact_1d(points, [2])[2]
    assert np.isclose(((points - c[kmeans.levels_of(points, c)]) ** 2).sum(), 0.9998, atol=0.05)
    v = rng.normal(size=3000)
    loss = lambda c: ((v - c[kmeans.levels_of(v, c)]) ** 2).mean()
    assert loss(kmeans.exact_1d(v, [8])[8]) <= loss(kmeans.lloyd_1d(v, 8)[0]) + 1e-12
    assert loss(kmeans.histogram_1d(v, [8])[8]) <= 1.02 * loss(kmeans.exact_1d(v, [8])[8])
    assert kmeans.levels_of(np.array([0.5]), np.array([0.0, 1.0])).tolist() == [0]


def test_allocation():
    var = np.sort(np.random.default_rng(1).gamma(1, size=24))[::-1]
    bits = allocation.rank_aware(var, 3)
    assert bits.sum() == 72 and (np.diff(bits) <= 0).all() and bits.max() <= 8
    assert allocation.rank_aware(var, 8).tolist() == [8] * 24 and allocation.rank_aware(var, 0).sum() == 0
    costs = var[:, None] * allocation.normal_distortion()[None, :]
    assert np.isclose(allocation.rescore(allocation.empirical(costs, 72), costs), allocation.rescore(allocation.optimal(costs, 72), costs))
    bumpy = np.tile([1, 0.95, 0.9, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05], (2, 1))
    assert allocation.rescore(allocation.optimal(bumpy, 3), bumpy) <= allocation.rescore(allocation.empirical(bumpy, 3), bumpy)
    tie = np.ones((3, 2))
    assert allocation.greedy(tie, 2).tolist() == [2, 0, 0]
    plan = allocation.segments(np.repeat(var, 8), 2, 16)
    assert sum(n for n, _ in plan) == 192 and sum(n * b for n, b in plan) <= 384
    assert allocation.normal_levels(1)[0].tolist() == [0.0] and allocation.normal_levels(1)[1] == 1.0


@pytest.mark.parametrize(("dims", "most", "want"), [(1536, 1536, 1536), (1536, 600, 512), (1536, 1, 1), (30, 7, 6)])
def test_largest_divisor(dims, most, want):
    assert allocation.largest_divisor(dims, most) == want


def test_bits_to_parameters():
    assert [allocation.scalar_bits(b) for b in (1, 4.5, 5, 12, 13)] == [4, 4, 8, 8, 16]
    assert [allocation.scalar_bits_exact(b) for b in (4, 5, 16)] == [4, 8, 16]
    assert allocation.subquantizers(1.5, 30) == 6 - 1 and allocation.subquantizers_clamped(1.5, 30) == 5
    assert allocation.subquantizers_clamped(3, 30, True) == 10 and allocation.subquantizers_floor(1, 64) == 8


@pytest.mark.parametrize("widths", [[4, 3, 3, 2, 2, 2], [4, 4, 3, 3, 2]])
def test_known_layouts(widths):
    assert bitpack.first_fit_layout(widths)[2] == 2 == bitpack.optimal_bytes(widths)


@pytest.mark.parametrize("seed", range(6))
def test_packing_round_trips(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(0, 9, 60) if seed else np.repeat(np.arange(1, 9), 8)
    codes = np.stack([rng.integers(0, 1 << w, 25) for w in widths], 1)
    byte, offset, size = bitpack.first_fit_layout(widths.tolist())
    assert np.array_equal(bitpack.unpack_layout(bitpack.pack_layout(codes, widths, byte, offset, size), widths, byte, offset), codes)
    assert np.array_equal(bitpack.unpack_dense(bitpack.pack_dense(codes, widths), widths), codes)
    assert -(-widths.sum() // 8) <= bitpack.optimal_bytes(widths.tolist()) <= size <= (widths > 0).sum()
    used = set()
    for w, b, o in zip(widths, byte, offset, strict=True):
        own = {(b, o + i) for i in range(w)}
        assert not own & used and (w == 0) == (b == -1) and o + w <= 8
        used |= own
    with pytest.raises(ValueError):
        bitpack.first_fit_layout([9])


def test_largest_budget():
    var = np.linspace(4, 0.1, 16)
    bits_for = lambda total: allocation.greedy(allocation.rank_aware_gains(var, 0), total).tolist()
    top = bitpack.largest_budget(bits_for, 6, 0, 128)
    assert bitpack.first_fit_layout(bits_for(top))[2] <= 6 < bitpack.first_fit_layout(bits_for(top + 1))[2]


# --- search ------------------------------------------------------------------------------


def brute(rows, q, k, metric="l2"):
    s = ((q[:, None] - rows[None]) ** 2).sum(2) if metric == "l2" else -(q @ rows.T)
    return np.argsort(s, axis=1, kind="stable")[:, :k]


def ids(results):
    return {r["qid"]: r["ids"] for r in knn.wide(results).collect()}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_search(spark, x, metric):
    q = normal(30, 32, 5)
    queries = datasets.as_queries(datasets.from_matrix(spark, q))
    got = ids(knn.search(x, queries, 10, metric))
    want = brute(matrix(x), q, 10, metric)
    assert all(got[i] == want[i].tolist() for i in range(30))
    assert knn.search(x, queries, 0).count() == 0 and knn.search(x, queries.limit(0), 5).count() == 0
    assert knn.search(x, queries.limit(1), 10_000).count() == 600


def test_search_in_query_blocks_and_ties(spark, x, monkeypatch):
    rows = np.tile(normal(3, 4), (20, 1))
    df = datasets.from_matrix(spark, rows).repartition(5)
    queries = datasets.as_queries(df.where("vec_id < 3"))
    assert {q: i[:4] for q, i in ids(knn.search(df, queries, 5)).items()} == {i: [i, i + 3, i + 6, i + 9] for i in range(3)}
    monkeypatch.setattr(grid, "QUERY_ROWS", 1)
    assert {q: i[:4] for q, i in ids(knn.search(df, queries, 5)).items()} == {i: [i, i + 3, i + 6, i + 9] for i in range(3)}


def test_normalised_search(spark, x):
    rows, q = matrix(x) * (1 + np.arange(600)[:, None] % 7), normal(10, 32, 2)
    got = ids(knn.normalised_ground_truth(datasets.from_matrix(spark, rows), datasets.as_queries(datasets.from_matrix(spark, q)), 10))
    want = brute(rows / np.linalg.norm(rows, axis=1, keepdims=True), q, 10, "ip")
    assert all(got[i] == want[i].tolist() for i in range(10))
    zero = datasets.from_matrix(spark, np.zeros((3, 4))).select(distance.floored_norm(F.col("v")).alias("n"))
    assert all(r["n"] > 0 for r in zero.collect())


def test_metric_names():
    assert distance.metric(1) == "l2" and distance.metric("METRIC_INNER_PRODUCT") == "ip" and distance.metric("Canberra") == "canberra" and distance.metric("NaNEuclidean") == "nan_euclidean"
    assert distance.metric("GOWER") == "gower" and distance.metric(25) == "gower"
    with pytest.raises(ValueError):
        distance.metric("hamming")


@pytest.mark.parametrize("codec", [None, codecs.Scalar(8), codecs.Product(8, 5, 3)])
def test_inverted_file_over_all_cells_is_a_flat_search(spark, x, codec):
    index = ivf.IVF(8, codec, iterations=3).fit(x)
    codes = index.encode().persist()
    queries = datasets.as_queries(datasets.from_matrix(spark, normal(10, 32, 5)))
    truth = knn.search(x, queries, 10)
    whole = metrics.recall_study(truth, index.search(codes, queries, 10, 8), 10).head()["recall"]
    part = metrics.recall_study(truth, index.search(codes, queries, 10, 2), 10).head()["recall"]
    assert whole >= part and whole >= (1.0 if codec is None else 0.9 if isinstance(codec, codecs.Scalar) else 0.3)
    assert codes.count() == 600


def test_scalar_codes_for_each_cell(spark):
    rows = np.concatenate([normal(40, 8), [[100.0] * 8]])
    df = datasets.from_matrix(spark, rows[::-1])
    index = ivf.IVF(5, codecs.Scalar(8), per_cell=True, iterations=4).fit(df)
    got = index.search(index.encode(), datasets.as_queries(df.where("vec_id = 0")), 1, 1).collect()
    assert got[0]["id"] == 0 and got[0]["score"] < 1e-9
    with pytest.raises(ValueError):
        ivf.IVF(5, None, per_cell=True)


def test_codebook_query(spark):
    books = np.array([[[0.0, 0], [2, 2]]])
    queries = datasets.as_queries(datasets.from_matrix(spark, np.array([[0.1, 0.1], [1.9, 1.9]])))
    got = ivf.codebook_query(books, queries, 2).where("rk = 1").orderBy("qid").collect()
    assert [r["id"] for r in got] == [0, 1]
    two = np.random.default_rng(0).normal(size=(2, 4, 4))
    rows = ivf.codebook_query(two, datasets.as_queries(datasets.from_matrix(spark, normal(5, 8))), 2).collect()
    assert len(rows) == 20 and all((r["id"] < 4) == (r["m"] == 0) for r in rows)
    with pytest.raises(ValueError):
        ivf.codebook_query(two, queries, 2, "l1")


def test_factory_keys():
    assert ivf.factory_key("pq", 4, 8) == "PQ4x8" and ivf.factory_key("sq", cells=16) == "IVF16,SQ8" and ivf.build("Flat") is None
    index = ivf.build("IVF16,PQ4x6")
    assert index.cells == 16 and index.codec.m == 4 and index.codec.bits == 6
    assert isinstance(ivf.build(ivf.factory_key("opq", 4, 8)), codecs.OptimizedProduct)
    assert ivf.default_cells(10_000) == 100 and ivf.default_cells(10**12) == 65536 and ivf.default_probes(100) == 10


# --- metrics, reports ------------------------------------------------------------------------


def test_recalls_on_known_lists(spark):
    table = lambda rows: spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(rows)], "qid long, rk int, id long")
    truth, found = table([0, 1, 2]), table([0, 9, 2])
    assert metrics.recall_study(truth, found, 1).head()["recall"] == 1
    assert metrics.recall_study(truth, found, 3).head()["recall"] == pytest.approx(2 / 3)
    assert metrics.recall_sweep(truth, found, 10).head()["recall"] == pytest.approx(0.2)
    assert metrics.rank_distortion(truth, found, 3).head()[1] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        metrics.rank_distortion(truth, found, 3, num_queries=5)
    assert metrics.recall_study(truth, found.limit(0), 3).head()["recall"] == 0
    both = truth.union(table([5, 6]).withColumn("qid", F.lit(1)))
    assert tuple(metrics.recalls_study(both, found, [1, 3]).head()) == pytest.approx(tuple(metrics.recall_study(both, found, k).head()["recall"] for k in (1, 3)))
    assert metrics.recalls_study(both, found.limit(0), [3]).head()[0] == 0


def test_errors_per_element_and_vector(spark):
    pairs = spark.createDataFrame([(i, [0.0] * 3, [1.0] * 3) for i in range(2)], "vec_id long, v array<double>, r array<double>")
    assert metrics.mse_per_element(pairs).head()[0] == 1 and metrics.distortion_per_vector(pairs).head()[0] == 3
    assert metrics.mse_per_element(pairs.limit(0)).head()[0] is None
    assert metrics.compression_factor(10, 4, 0) == float("inf")


def test_speed():
    assert metrics.qps_mean(lambda: sum(range(1000)), 10)[0] > 0 and metrics.qps_best(lambda: 7, 10)[1] == 7
    with pytest.raises(ValueError):
        metrics.qps_mean(lambda: 0, 0)


def test_attribution(spark):
    runs = spark.createDataFrame([("o", 1.0, 10.0), ("a", 1.0, 8.0), ("b", 1.0, 7.0), ("ab", 1.0, 4.0)], "method string, bpd double, mse double")
    assert tuple(report.attribution(runs, "o", "a", "b", "ab").head()) == (1.0, 2.0, 3.0, 6.0, 1.0)


# --- sources, logs, streams, studies ---------------------------------------------------------


def test_vector_files(spark, tmp_path, x):
    rows = normal(300, 6).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    fvecs.write(datasets.from_matrix(spark, rows).withColumnRenamed("v", "embedding"), path)
    assert open(path, "rb").read() == fvecs.dump(rows)
    assert np.array_equal(matrix(fvecs.read(spark, path), "embedding").astype(np.float32), rows)
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.fvecs").write_bytes(fvecs.dump(rows[i * 100 : i * 100 + 100]))
    assert np.array_equal(matrix(fvecs.read(spark, str(tmp_path / "many")), "embedding").astype(np.float32), rows)
    assert fvecs.parse(b"").shape == (0, 0)
    good = fvecs.dump(rows)
    for bad in (good[:-1], b"\0\0\0\0" + good[4:], b"\xff\xff\xff\xff" + good[4:], good[:28] + b"\x05\0\0\0" + good[32:]):
        with pytest.raises(ValueError):
            fvecs.parse(bad)
    with pytest.raises(ValueError):
        fvecs.parse(b"", strict=False)
    with pytest.raises(ValueError):
        fvecs.dump(np.zeros(3))
    ints = np.arange(6, dtype=np.int32).reshape(2, 3)
    assert np.array_equal(fvecs.parse(fvecs.dump(ints, "<i4"), "<i4"), ints)


@pytest.mark.parametrize("codec", [codecs.Scalar(4), codecs.Product(8, 4, 2), codecs.OptimizedProduct(8, 3, 2, 1), codecs.SignBit(), codecs.MultiBit(3), codecs.Local(5), codecs.RankAware(3), codecs.Segmented(3)])
def test_saved_codecs(spark, tmp_path, x, codec):
    codec.fit(x)
    models.save_codec(spark, codec, str(tmp_path / "m"))
    again = models.load_codec(spark, str(tmp_path / "m"))
    rows = matrix(x)[:50]
    assert np.array_equal(again._encode(rows), codec._encode(rows)) and again.code_size() == codec.code_size()
    if isinstance(codec, (codecs.Product, codecs.Scalar)):
        models.export_codebook(spark, codec, str(tmp_path / "book"), codec.encode(x))
        book = fvecs.parse((tmp_path / "book.fvecs").read_bytes())
        assert book.shape == ((2, 32) if isinstance(codec, codecs.Scalar) else (8 << codec.bits, 4))
        sent = fvecs.parse((tmp_path / "book.codes.ivecs").read_bytes(), "<i4")
        assert np.array_equal(sent[:50], codec._encode(rows))
    else:
        with pytest.raises(RuntimeError):
            models.codebook(codec)


def test_saved_index(spark, tmp_path, x):
    queries = datasets.as_queries(datasets.from_matrix(spark, normal(5, 32, 9)))
    for codec, per_cell in ((codecs.Scalar(8), True), (codecs.Product(8, 4, 2), False)):
        index = ivf.IVF(6, codec, per_cell=per_cell, iterations=2).fit(x)
        codes = index.encode()
        models.save_index(index, codes, str(tmp_path / "i"))
        again, stored = models.load_index(spark, str(tmp_path / "i"))
        assert ids(again.search(stored, queries, 5, 2)) == ids(index.search(codes, queries, 5, 2))


def test_csv(spark, tmp_path):
    models.write_csv(spark.createDataFrame([(1, None), (2, "b")], "a int, b string").orderBy("a"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == "a,b\n1,\n2,b\n"


def test_dataset_folders(spark, tmp_path):
    train, query = normal(50, 4), normal(5, 4, 1)
    np.save(tmp_path / "train.npy", train)
    held = datasets.load_folder(spark, str(tmp_path), 10)
    assert held.vectors.count() == 40 and [r[0] for r in held.queries.select("qid").orderBy("qid").collect()] == list(range(40, 50))
    np.save(tmp_path / "queries.npy", query)
    np.save(tmp_path / "groundtruth.npy", brute(train, query, 3))
    full = datasets.load_folder(spark, str(tmp_path))
    assert metrics.recall_study(full.truth, knn.search(full.vectors, full.queries, 3), 3).head()["recall"] == 1
    other = tmp_path / "other"
    other.mkdir()
    (other / "base.fvecs").write_bytes(fvecs.dump(train.astype(np.float32)))
    (other / "query.fvecs").write_bytes(fvecs.dump(query.astype(np.float32)))
    (other / "groundtruth.ivecs").write_bytes(fvecs.dump(brute(train, query, 3), "<i4"))
    files = datasets.load_folder(spark, str(other))
    assert metrics.recall_study(files.truth, knn.search(files.vectors, files.queries, 3), 3).head()["recall"] == 1
    assert datasets.load_folder(spark, "synthetic").queries.count() == 100
    with pytest.raises(FileNotFoundError):
        datasets.load_folder(spark, str(tmp_path / "none"))


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tone text\n2\n3\tthree\textra\n")
    rows = datasets.read_collection(spark, str(tmp_path / "c.tsv"))
    assert sorted(map(tuple, rows.collect())) == [("1", "one text"), ("3", "three")]
    assert datasets.read_collection(spark, str(tmp_path / "c.tsv"), 1).count() == 1
    df = spark.createDataFrame([("b", "t")], "body string, title string")
    assert datasets.text_column(df).head()[0] == "b"
    with pytest.raises(ValueError):
        datasets.text_column(df.select("title"))
    texts = spark.createDataFrame([(0, "ab"), (1, "c")], "vec_id long, text string")
    got = datasets.encode_texts(texts, lambda ts: [[len(t), 1] for t in ts], 2)
    assert sorted(r["v"] for r in got.collect()) == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(ValueError):
        datasets.openai_table(spark, "x", 7)
    assert datasets.dummy(spark, 20, 8).select(F.size("v")).distinct().head()[0] == 8


def test_truth_files(spark, tmp_path, x):
    got = datasets.precompute_truth(x, str(tmp_path / "gt"), 5, 3)
    assert got.count() == 15
    made = []

    def make():
        made.append(1)
        return knn.search(x, datasets.first_queries(x, 5), 3)

    for _ in range(2):
        assert datasets.cached_truth(spark, str(tmp_path), (600, 5, 3), make).count() == 15
    assert len(made) == 1


def test_config(tmp_path):
    text = "dataset:\n  name: d\n  base_fvecs: /a b\n  query_fvecs: '/q'\n  n_queries: 7  # few\nmethods: [pq, sq]\nbpd:\n  - 1\n  - 2.5\noutput_dir: out\n"
    (tmp_path / "c.yaml").write_text(text)
    c = datasets.load_config(str(tmp_path / "c.yaml"))
    assert (c.name, c.base, c.queries, c.n_queries, c.methods, c.bpd, c.ks, c.chunk_size, c.mse_sample, c.output_dir) == ("d", "/a b", "/q", 7, ["pq", "sq"], [1, 2.5], [1, 10, 100], 50_000, 100_000, "out")
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"name": "d", "base_fvecs": "a", "query_fvecs": "q"}, "methods": ["sq"], "bpd": [4], "ks": [5]}))
    assert datasets.load_config(str(tmp_path / "c.json")).ks == [5]


def test_timestamped_paths():
    now = datetime(2026, 4, 13, 14, 22, 1, tzinfo=UTC)
    assert datasets.timestamped("results/msmarco_100k.csv", now) == "results/msmarco_100k_20260413_142201.csv"


def test_run_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    runlog.log_run(spark, "pq", "d", {"recall": np.float32(0.5), "rank_distortion@10": 0.25}, {"m": np.int64(8)}, "s1", path)
    runlog.log_run(spark, "sq", "d", {"recall": 0.75}, path=path)
    runs = runlog.load_runs(spark, path)
    assert [r["method"] for r in runs.collect()][0] in ("pq", "sq") and runs.count() == 2
    got = runlog.load_runs(spark, path, "s1").select(runlog.metric("recall").alias("r"), runlog.metric("none").alias("n"), runlog.rank_metric().alias("k")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0, 0.25)]
    monkeypatch.setenv("DB_PATH", "elsewhere")
    assert runlog.log_path() == "elsewhere" and runlog.log_path("here") == "here"
    cells = spark.createDataFrame([("pq", 1), ("pq", 2)], "method string, bpd int")
    assert runlog.pending(cells, cells.where("bpd = 1"), ["method", "bpd"]).collect()[0]["bpd"] == 2


def test_streams(spark, tmp_path, x):
    parts = tmp_path / "in"
    x.withColumnRenamed("v", "embedding").repartition(5).write.parquet(str(parts))
    codec = codecs.Scalar(4).fit(x)
    whole = metrics.distortion_per_vector(codec.reconstruct(x)).head()
    got = sweep.streaming_distortion(sweep.stream_vectors(spark, str(parts)), codec, str(tmp_path / "cp1"), "whole").head()
    assert got[0] == pytest.approx(whole[0]) and got[1] == 600
    some = sweep.streaming_distortion(sweep.stream_vectors(spark, str(parts)), codec, str(tmp_path / "cp2"), max_batches=2).head()
    assert 0 < some[1] < 600


def test_study_with_checkpoint(spark, tmp_path, x):
    queries = datasets.as_queries(datasets.from_matrix(spark, normal(8, 32, 9)))
    path = str(tmp_path / "cells")
    first = study.run_study(x, queries, ["sq", "lvq"], [4], (1, 10), "d", path)
    assert first.count() == 2
    rows = study.run_study(x, queries, ["sq", "lvq"], [4, 8], (1, 10), "d", path).collect()
    assert len(rows) == 4 and all(0 <= r["recall_at_10"] <= 1 and r["compression_factor"] > 1 for r in rows)
    assert {r["code_bytes"] for r in rows if r["method"] == "sq" and r["bpd"] == 8} == {600 * 32 + 600 * 4}
    with pytest.raises(ValueError):
        study.build("nothing", 4, 32)
    assert len(study.METHODS) == 12


@pytest.mark.parametrize("method", ["pq", "opq", "sq"])
@pytest.mark.parametrize("bpd", [1, 4])
def test_registered_methods_fit(x, method, bpd):
    assert error(study.build(method, bpd, 32), x) < 1.0


def test_compare_and_sweeps(spark, x):
    queries = datasets.as_queries(datasets.from_matrix(spark, normal(8, 32, 9)))
    rows = study.compare(x, queries, ["sq_flat", "rabitq", "rabitq_ivf", "saq", "unknown"], 4, 5, 16, 8).collect()
    by = {r["method"]: r for r in rows}
    assert set(by) == {"sq_flat", "rabitq", "rabitq_ivf", "saq"} and all(r["recall_at_k"] is not None and r["qps"] > 0 for r in rows)
    assert by["saq"]["memory_bytes"] == 600 * 32 * 4 // 8 + 16 * 32 * 4
    assert by["sq_flat"]["recall_at_k"] > 0.5
    out = study.sweep(x, queries, study.grid("pq", "4,8", "4") + study.grid("sq", bits="4,8"), pairs=50).collect()
    assert len(out) == 3 and all(r["recall_10"] <= 1 for r in out)
    assert len(study.grid("saq")) == 4 and study.grid("rabitq", metric="L2,1")[1]["metric"] == "l2"


# --- registered queries against SQL ------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, data, name):
    if name == "study_trained":
        pytest.skip("slow; the driver's own comparison runs it")
    got = registry.queries()[name](spark, data).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    want = con.sql(sql).df()[list(got.columns)]
    key = lambda f: sorted(tuple("None" if v is None or v != v else repr(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)


def test_entry_point_without_the_training_data_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/vecpress", tmp_path / "vecpress", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "vecpress" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
