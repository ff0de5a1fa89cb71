"""Searches by strips of queries and rows, look-up tables, codecs of cells, blocks and stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.functions import arrays, distance
from vecpress.operators import blocks, codecs, grid, ivf, kmeans, knn
from vecpress.sources import datasets


def normal(n, d, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d))


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rk").collect():
        out.setdefault(r["qid"], []).append((r["id"], r["score"]))
    return out


def brute(rows, q, k):
    d = ((q[:, None, :] - rows[None, :, :]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def table(spark):
    return datasets.from_matrix(spark, normal(500, 16)).repartition(5)


# --- strips --------------------------------------------------------------------------------


@pytest.mark.parametrize("strip", [1, 7, 29, 30, 1000])
def test_strips_change_nothing(spark, table, strip):
    q = normal(30, 16, 3)
    queries = datasets.as_queries(datasets.from_matrix(spark, q)).repartition(3)
    got = lists(knn.search(table, queries, 9, strip=strip))
    want = brute(normal(500, 16), q, 9)
    assert all([i for i, _ in got[n]] == want[n].tolist() for n in range(30))


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_cells_in_strips(spark, table, metric):
    queries = datasets.as_queries(table.where("vec_id % 11 = 0"))
    index = ivf.IVF(6, codecs.Product(4, 4, 3), metric, iterations=3).fit(table)
    codes = index.encode()
    whole = lists(index.search(codes, queries, 8, 3))
    assert lists(index.search(codes, queries, 8, 3, strip=4)) == whole
    looked = lists(index.search(codes, queries, 8, 3, tables=True, strip=5))
    assert {n: [i for i, _ in r] for n, r in looked.items()} == {n: [i for i, _ in r] for n, r in whole.items()}
    assert all(abs(a - b) < 1e-9 for n in whole for (_, a), (_, b) in zip(whole[n], looked[n], strict=True))


def test_a_hot_cell_is_spread(spark):
    """Nine rows in ten are one cell's: its rows and queries go to many strips."""
    rows = np.concatenate([normal(900, 8) * 0.01, normal(100, 8, 1) * 5 + 20])
    df = datasets.from_matrix(spark, rows).repartition(4)
    index = ivf.IVF(4, None, iterations=3).fit(df)
    queries = datasets.as_queries(df.where("vec_id % 5 = 0"))
    assert lists(index.search(index.encode(), queries, 5, 2, strip=16)) == lists(index.search(index.encode(), queries, 5, 2))


def test_fifty_thousand_queries(spark):
    """Four strips of queries; none of them passes the driver."""
    rows, q = normal(300, 4), normal(50_000, 4, 2)
    found = knn.search(datasets.from_matrix(spark, rows), datasets.as_queries(datasets.from_matrix(spark, q)), 2)
    got = found.orderBy("qid", "rk").toPandas()
    assert len(got) == 100_000
    best = np.concatenate([brute(rows, q[i : i + 5000], 2) for i in range(0, 50_000, 5000)])
    assert (got["id"].to_numpy().reshape(-1, 2) == best).all()


def test_strips_are_bounded_by_bytes(monkeypatch):
    assert grid.queries_a_strip(100, 100 * 80) == grid.QUERY_ROWS
    monkeypatch.setattr(grid, "QUERY_BYTES", 800)
    assert grid.queries_a_strip(100, 100 * 80) == 8 and grid.queries_a_strip(1, 8000) == 1 and grid.queries_a_strip(0, 0) == 0


def test_strips_copy_no_rows(spark, table):
    """Fifteen strips, or five of an index's cells, and every row is read where it is."""
    queries = datasets.as_queries(table.where("vec_id < 30"))
    index = ivf.IVF(6, None, iterations=3).fit(table)
    for found in (knn.search(table, queries, 9, strip=2), index.search(index.encode(), queries, 9, 3, strip=2)):
        assert "__side" not in found._jdf.queryExecution().toString()


def test_queries_beyond_one_strip(spark, table, monkeypatch):
    """Queries that no task holds at once: both sides are dealt, with cells and without."""
    queries = datasets.as_queries(table.where("vec_id % 5 = 0"))
    index = ivf.IVF(6, None, iterations=3).fit(table)
    want = lists(knn.search(table, queries, 9)), lists(index.search(index.encode(), queries, 9, 3))
    monkeypatch.setattr(grid, "QUERY_ROWS", 16)
    got = knn.search(table, queries, 9, strip=3), index.search(index.encode(), queries, 9, 3, strip=3)
    assert all("__side" in g._jdf.queryExecution().toString() for g in got)
    assert tuple(map(lists, got)) == want


def test_staged_search_is_spread(spark, table):
    """One run of blocks is built by one task and searched by all; strips copy no block."""
    codec = codecs.Segmented(3, rounds=0, rotate=False, axes=False, metric="ip").fit(table)
    queries = datasets.as_queries(table.where("vec_id < 30"))
    made = blocks.to_blocks(codec, codec.encode(table))
    found = blocks.staged_search(codec, made, queries, 9, strip=3)
    assert "__side" not in found._jdf.queryExecution().toString()
    assert blocks._spread(made.coalesce(1)).rdd.getNumPartitions() >= 4
    got, want = lists(found), lists(blocks.staged_search(codec, made, queries, 9))
    assert all([i for i, _ in got[n]] == [i for i, _ in want[n]] and np.allclose([s for _, s in got[n]], [s for _, s in want[n]]) for n in range(30))


def test_fewer_rows_than_k_and_no_queries(spark, table):
    queries = datasets.as_queries(table.where("vec_id < 3"))
    assert {len(r) for r in lists(knn.search(table.limit(4), queries, 9, strip=1)).values()} == {4}
    assert knn.search(table, queries.limit(0), 9).count() == 0
    assert knn.search_metric(table, queries, 0, "l1").count() == 0


# --- any metric ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(distance.METRICS))
def test_measures_of_pairs_equal_expressions(spark, name):
    a, b = np.abs(normal(6, 9)) + 0.1, normal(40, 9, 1)
    pairs = distance.PAIRWISE[name](a, b)
    df = spark.createDataFrame([(i, j, a[i].tolist(), b[j].tolist()) for i in range(6) for j in range(40)], "i int, j int, a array<double>, b array<double>")
    for r in df.select("i", "j", distance.METRICS[name][0](F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r["s"] - pairs[r["i"], r["j"]]) < 1e-9


def test_undefined_measures_come_last(spark):
    rows = datasets.from_matrix(spark, np.array([[np.nan, np.nan], [1.0, np.nan], [3.0, 4.0]]))
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, q array<double>")
    got = lists(knn.search_metric(rows, queries, 3, "nan_euclidean"))[0]
    assert [i for i, _ in got] == [1, 2, 0] and not np.isfinite(got[2][1])
    zeros = datasets.from_matrix(spark, np.zeros((2, 2)))
    assert [i for i, _ in lists(knn.search_metric(zeros, queries.withColumn("q", F.array(F.lit(0.0), F.lit(0.0))), 2, "braycurtis"))[0]] == [0, 1]


def test_gower_by_hand(spark):
    nan = float("nan")
    rows = np.array([[0.0, -1.0, 5.0, nan], [10.0, -2.0, 5.0, 1.0], [5.0, 3.0, 5.0, 2.0], [nan, nan, nan, nan]])
    queries = spark.createDataFrame([(7, [0.0, -1.0, 5.0, 1.0])], "qid long, q array<double>")
    got = lists(knn.search_metric(datasets.from_matrix(spark, rows), queries, 4, "gower"))[7]
    # spans 10, 0 (one number only), 0, 1; a category against a number differs by one
    assert [i for i, _ in got] == [0, 1, 2, 3]
    assert np.allclose([s for _, s in got[:3]], [0.0, (1 + 1 + 0 + 0) / 4, (0.5 + 1 + 0 + 1) / 4]) and not np.isfinite(got[3][1])


# --- look-up tables ------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("codec", [codecs.Product(4, 5, 3), codecs.OptimizedProduct(4, 4, 3, 2), codecs.Scalar(4), codecs.Scalar(8), codecs.RankAware(3, codebook="gaussian"), codecs.RankAware(3, packing="dense", codebook="gaussian")], ids=lambda c: f"{c.name}{getattr(c, 'bits', '')}{getattr(c, 'packing', '')}")
def test_tables_equal_decoded_rows(spark, codec, metric, monkeypatch):
    x = datasets.from_matrix(spark, normal(300, 16) * np.linspace(3, 0.3, 16) + 1).repartition(3)
    codec.fit(x)
    codes, queries = codec.encode(x), datasets.as_queries(datasets.from_matrix(spark, normal(9, 16, 4)))
    want = lists(ivf.flat_search(codec, codes, queries, 12, metric))
    monkeypatch.setattr(codecs.Codec, "_decode", None)
    monkeypatch.setattr(type(codec), "_decode", None)
    got = lists(ivf.table_search(codec, codes, queries, 12, metric))
    for n in want:
        assert np.allclose([s for _, s in got[n]], [s for _, s in want[n]], atol=1e-9)
        ties = {round(s, 9) for _, s in want[n]}
        assert [i for i, _ in got[n]] == [i for i, _ in want[n]] or len(ties) < 12


def test_codecs_without_tables(spark, table):
    codec = codecs.Scalar(16).fit(table)
    with pytest.raises(Exception, match="look-up tables"):
        ivf.table_search(codec, codec.encode(table), datasets.as_queries(table.limit(1)), 1).collect()


# --- a codec for each cell -----------------------------------------------------------------


@pytest.mark.parametrize("codec", [codecs.Product(4, 3, 4), codecs.Local(4), codecs.Scalar(8)], ids=lambda c: c.name)
def test_codec_of_each_cell(spark, table, codec):
    """Codes of a cell are those of a codec that is fitted on the cell's residuals."""
    index = ivf.IVF(5, codec, per_cell=True, iterations=3).fit(table)
    rows, c = normal(500, 16), index.centroids
    cell, _ = kmeans.nearest(rows, c)
    own = {}
    for n in np.unique(cell):
        own[n] = type(codec)(*((4, 3, 4) if codec.name == "pq" else (codec.bits,))).fit_rows((rows - c[cell])[cell == n])
    for r in index.encode().collect():
        n = cell[r["vec_id"]]
        assert r["cell"] == n and bytes(r["code"]) == own[n]._encode((rows[r["vec_id"]] - c[n])[None])[0].tobytes()
    queries = datasets.as_queries(table.where("vec_id % 50 = 0"))
    found = lists(index.search(index.encode(), queries, 10, 5))
    near = brute(rows, rows[::50], 10)
    assert np.mean([len({i for i, _ in found[50 * n]} & set(near[n])) for n in range(10)]) > (3 if codec.name == "pq" else 8)


def test_codebooks_of_large_cells_see_all_rows(spark, table, monkeypatch):
    monkeypatch.setattr(ivf, "CELL_ROWS", 20)
    test_codec_of_each_cell(spark, table, codecs.Product(4, 3, 4))


def test_an_index_of_own_codecs_is_saved(spark, table, tmp_path):
    from vecpress.sources import models

    index = ivf.IVF(4, codecs.Product(4, 3, 3), per_cell=True, iterations=2).fit(table)
    queries = datasets.as_queries(table.where("vec_id % 50 = 0"))
    models.save_index(index, index.encode(), str(tmp_path / "index"))
    again, codes = models.load_index(spark, str(tmp_path / "index"))
    assert lists(again.search(codes, queries, 5, 2)) == lists(index.search(index.encode(), queries, 5, 2))
    assert lists(again.search(codes, queries, 5, 2, tables=True)).keys() == {50 * i for i in range(10)}


def test_cells_of_few_rows_keep_them(spark):
    """A cell of fewer rows than centroids has them as its centroids: its codes lose nothing."""
    rows = normal(20, 4)
    df = datasets.from_matrix(spark, rows)
    index = ivf.IVF(6, codecs.Product(2, 5, 5), per_cell=True, iterations=2).fit(df)
    got = lists(index.search(index.encode(), datasets.as_queries(df), 1, 6))
    assert all(got[n][0][0] == n and got[n][0][1] < 1e-20 for n in range(20))


def test_codecs_of_cells_have_a_bound(spark, table, monkeypatch):
    monkeypatch.setattr(ivf, "CELL_CODECS_BYTES", 100)
    with pytest.raises(ValueError, match="fewer cells"):
        ivf.IVF(5, codecs.Product(4, 3), per_cell=True, iterations=1).fit(table)
    with pytest.raises(ValueError):
        ivf.IVF(5, None, per_cell=True)


# --- blocks and stages ---------------------------------------------------------------------

SEGMENTED = [dict(avg_bits=3), dict(avg_bits=4, metric="ip"), dict(avg_bits=1), dict(avg_bits=3, codebook="lloyd", rounds=2), dict(avg_bits=2, rounds=0, rotate=False, axes=False)]


def tapered(spark, n=700, d=48):
    return datasets.from_matrix(spark, normal(n, d) * np.linspace(4, 0.2, d) + 0.3).repartition(4)


@pytest.mark.parametrize("kind", SEGMENTED, ids=lambda k: "-".join(map(str, k.values())))
def test_blocks_and_stages(spark, kind):
    x = tapered(spark)
    codec = codecs.Segmented(**kind).fit(x)
    codes = codec.encode(x)
    table = blocks.to_blocks(codec, codes)
    sizes = sorted(len(r["ids"]) for r in table.collect())
    assert sizes == [700 % 32] + [32] * (700 // 32)
    back = {r["vec_id"]: bytes(r["code"]) for r in blocks.from_blocks(codec, table).collect()}
    assert back == {r["vec_id"]: bytes(r["code"]) for r in codes.collect()}
    queries = datasets.as_queries(x.where("vec_id % 20 = 0"))
    want, got = lists(ivf.estimate_search(codec, codes, queries, 10)), lists(blocks.staged_search(codec, table, queries, 10))
    assert {n: [i for i, _ in r] for n, r in got.items()} == {n: [i for i, _ in r] for n, r in want.items()}
    assert all(abs(a - b) < 1e-6 * (1 + abs(a)) for n in want for (_, a), (_, b) in zip(want[n], got[n], strict=True))
    assert lists(blocks.staged_search(codec, table, queries, 10, strip=6)).keys() == want.keys()


def test_stages_leave_rows_early(spark):
    x = tapered(spark, 4000).withColumn("v", F.transform("v", lambda e: e * (1 + F.col("vec_id") % 9)))
    codec = codecs.Segmented(4).fit(x)
    table = blocks.to_blocks(codec, codec.encode(x))
    left = {r["stage"]: r["pairs"] for r in blocks.stage_counts(codec, table.coalesce(1), datasets.as_queries(x.where("vec_id % 100 = 0")), 10).collect()}
    assert left[0] == 4000 * 40 and left[0] > left[1] > left[2] >= left[3] > 0 and left[3] < left[0] * 0.6


def test_blocks_of_cells(spark):
    x = tapered(spark, 600, 32)
    index = ivf.IVF(5, codecs.Segmented(3), iterations=2).fit(x)
    table = blocks.to_blocks(index.codec, index.encode())
    queries = datasets.as_queries(x.where("vec_id % 30 = 0"))
    want = lists(index.search(index.encode(), queries, 8, 3, estimate=True))
    got = lists(blocks.staged_search(index.codec, table, queries, 8, index.centroids, lambda q: ivf.probe(q, index.centroids, 3)))
    assert {n: [i for i, _ in r] for n, r in got.items()} == {n: [i for i, _ in r] for n, r in want.items()}


def test_runs_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RUN", 100)
    x = tapered(spark, 450, 16)
    codec = codecs.Segmented(3).fit(x)
    table = blocks.to_blocks(codec, codec.encode(x))
    ids = [i for r in table.collect() for i in r["ids"]]
    assert sorted(ids) == list(range(450)) and len({r["block"] >> 40 for r in table.collect()}) == 5


def test_error_factors_hold_estimates(spark):
    """The interval of the published factor holds nine estimates of ten and more."""
    x = tapered(spark, 500, 64)
    codec = codecs.Segmented(4, rounds=0).fit(x)
    rows, q = normal(500, 64) * np.linspace(4, 0.2, 64) + 0.3, normal(50, 64, 8)
    y, asked = (rows - codec.mean) @ codec.axes, q @ codec.axes
    code = codec._encode(rows)
    inside = []
    for (own, bits, turn), (_, _, factors), (point, _, _) in zip(codec._pieces(), blocks.split(codec, code), codec.unpack(code), strict=True):
        if bits:
            true, near = asked[:, own] @ turn @ (y[:, own] @ turn).T, asked[:, own] @ turn @ point.T
            inside.append((np.abs(true - near) <= factors[None, :, 2] * np.sqrt((asked[:, own] ** 2).sum(1))[:, None]).mean())
    assert min(inside) > 0.9


# --- vectors and ids as they come ----------------------------------------------------------


def test_ragged_and_null_vectors_are_refused(spark):
    ragged = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0] * 5), (2, [1.0] * 4)], "vec_id long, v array<double>")
    queries = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "qid long, q array<double>")
    with pytest.raises(Exception, match="unequal length"):
        knn.search(ragged.coalesce(1), queries, 1).collect()
    holes = spark.createDataFrame([(0, [1.0, None]), (1, None)], "vec_id long, embedding array<double>")
    kept = arrays.vectors(holes)
    assert kept.count() == 1 and np.isnan(arrays.to_matrix(kept.toArrow()["v"])[0]).tolist() == [False, True]


@pytest.mark.parametrize("ids", [list(range(0, 100, 10)), [-5, 3, 3, 9, 1 << 40, -(1 << 40), 7], [4], list(range(3000))])
def test_splits_go_by_rank(spark, ids):
    x = spark.createDataFrame([(i, [float(i)]) for i in ids], "vec_id long, v array<double>").repartition(3)
    want = sorted(ids)
    for place in {0, len(ids) // 2, len(ids) - 1}:
        assert datasets.id_at(x, place) == want[place]
    base, queries = datasets.base_and_queries(x, len(ids) * 4 // 5, len(ids) - len(ids) * 4 // 5)
    assert base.count() + queries.count() == len(ids)
    base, queries = datasets.holdout(x, 2)
    assert base.count() + queries.count() == len(ids) and queries.count() >= min(2, len(ids))
    assert datasets.holdout(x, 0)[0].count() == len(ids) and datasets.holdout(x.limit(0), 3)[1].count() == 0


# --- many cells ----------------------------------------------------------------------------


@pytest.mark.parametrize("k, spread", [(256, 1.0), (700, 0.05), (300, 0.0)])
def test_groups_find_the_nearest(k, spread):
    """Equal to comparing all centroids, ties and copies included, and most are never touched."""
    rng = np.random.default_rng(k)
    middles = rng.standard_normal((20, 8)) * 10
    c = middles[rng.integers(0, 20, k)] + spread * rng.standard_normal((k, 8))
    rows = np.concatenate([middles[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 8)) * 0.3, c[:50], np.full((1, 8), 1e6), np.zeros((1, 8))])
    grouped = kmeans.Grouped(c)
    cell, d = grouped.nearest(rows)
    want, dist = kmeans.nearest(rows, c)
    assert np.array_equal(cell, want) and np.array_equal(d, dist)
    assert grouped.touched < 0.5 * len(rows) * k


def test_spread_starts_find_clusters_that_first_rows_miss(spark):
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((12, 6)) * 20
    rows = np.concatenate([middles[0] + rng.standard_normal((400, 6)) * 0.1] + [m + rng.standard_normal((40, 6)) * 0.1 for m in middles[1:]])
    x = datasets.from_matrix(spark, rows).repartition(3)
    start = kmeans.spread_rows(x, 12)
    assert np.array_equal(start, kmeans.spread_rows(x.repartition(5), 12))
    error = lambda c: kmeans.nearest(rows, c)[1].mean()
    plain, spread = kmeans.kmeans(x, 12, 3), kmeans.kmeans(x, 12, 3, start=start)
    assert error(spread) < 0.2 < error(plain)
    assert len(kmeans.spread_rows(datasets.from_matrix(spark, np.ones((5, 3))), 4)) == 1


def test_spread_starts_in_groups(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "GROUPED", 8)
    rows = normal(1500, 5)
    x = datasets.from_matrix(spark, rows).repartition(4)
    got = kmeans.spread_rows(x, 100)
    assert 90 <= len(got) <= 100 and len(np.unique(got, axis=0)) == len(got)
    assert kmeans.nearest(rows, got)[1].mean() < 1.3 * kmeans.nearest(rows, rows[:100])[1].mean()


def test_an_index_of_many_spread_cells(spark):
    rows = normal(3000, 6)
    x = datasets.from_matrix(spark, rows).repartition(4)
    index = ivf.IVF(300, None, iterations=1, spread=True, rows_per_cell=None).fit(x)
    cell = {r["vec_id"]: r["cell"] for r in index.encode().collect()}
    want, _ = kmeans.nearest(rows, index.centroids)
    assert all(cell[i] == want[i] for i in range(3000))
    found = lists(index.search(index.encode(), datasets.as_queries(x.where("vec_id % 100 = 0")), 5, 300))
    assert all([i for i, _ in found[100 * n]] == brute(rows, rows[100 * n][None], 5)[0].tolist() for n in range(30))
