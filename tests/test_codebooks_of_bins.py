"""Codebooks from counted bins against those on the values themselves."""

import numpy as np
import pytest

from vecpress.operators import codebooks, kmeans
from vecpress.sources import datasets


def values(n=3000):
    rng = np.random.default_rng(1)
    columns = [rng.standard_normal(n), rng.exponential(size=n) ** 3, np.round(rng.standard_normal(n), 1), np.full(n, 2.5), rng.choice([-1e6, 0.0, 1e-9, 1e6], n), np.where(rng.random(n) < 0.33, 7.0, rng.random(n))]
    return np.stack(columns, axis=1)


@pytest.fixture(scope="module")
def table(spark):
    return datasets.from_matrix(spark, values()).repartition(5)


@pytest.mark.parametrize("bins", [2, 16, 4096])
def test_order_statistics(table, bins):
    v, found = np.sort(values(), axis=0), codebooks.Bins(table, bins)
    assert found.rows() == 3000
    ranks = np.array([0, 1, 7, 1499, 1500, 2998, 2999])
    assert np.array_equal(found.at_ranks(ranks), v[ranks].T)
    shares = np.array([0.0, 0.1, 0.333, 0.5, 0.9, 1.0])
    assert np.allclose(found.quantiles(shares), np.quantile(v, shares, axis=0).T, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("bins", [3, 4096])
@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_lloyd_on_bins_is_lloyd_on_values(table, bins, k):
    got = codebooks.lloyd(codebooks.Bins(table, bins), k)
    for d, column in enumerate(values().T):
        want, _ = kmeans.lloyd_1d(column, k)
        if d == 2:  # a tenth's grid has values on borders, which rounding may put on either side: any fixed point will do
            own = kmeans.levels_of(column, np.sort(got[d]))
            assert np.allclose([column[own == j].mean() if (own == j).any() else c for j, c in enumerate(np.sort(got[d]))], np.sort(got[d]), atol=1e-6) or k == 1
            continue
        assert np.allclose(np.sort(got[d]), np.sort(want), rtol=1e-6, atol=1e-6 * (1 + np.abs(column).max() * 1e-6)), d


@pytest.mark.parametrize("bins", [256, 4096])
def test_exact_on_bins_is_exact_on_values(table, bins):
    got = codebooks.exact(codebooks.Bins(table, bins), [1, 2, 4, 8])
    for k, books in got.items():
        for d, column in enumerate(values().T):
            want = kmeans.exact_1d(column, [k])[k]
            mse = [((column - c[kmeans.levels_of(column, c)]) ** 2).mean() for c in (np.sort(books[d]), np.sort(want))]
            assert mse[0] <= mse[1] * (1 + 1e-9) + 1e-12, (k, d)


def test_restarts_leave_a_bad_start(spark):
    """From the quantiles of this dimension two of three centroids share the heavy cluster."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.1, 900), rng.normal(50, 0.1, 150), rng.normal(100, 0.1, 150)])[:, None]
    x = datasets.from_matrix(spark, v).repartition(3)
    error = lambda c: ((v[:, 0] - np.sort(c)[kmeans.levels_of(v[:, 0], np.sort(c))]) ** 2).mean()
    plain, more = (codebooks.lloyd(x, 3, restarts=r, seed=0)[0] for r in (0, 4))
    assert error(plain) > 1 and error(more) < 0.05 and np.array_equal(more, codebooks.lloyd(x, 3, restarts=4, seed=0)[0])


def test_levels_of_all_dimensions(table):
    for method in ("lloyd", "exact", "histogram"):
        books = kmeans.per_dimension(table, [0, 1, 3], method)
        assert set(books) == {(d, b) for d in range(6) for b in (0, 1, 3)} and all(books[d, 0].tolist() == [0] for d in range(6))
        assert books[3, 3].min() == books[3, 3].max() == 2.5


def test_levels_by_dimension_take_few_jobs(spark, table, monkeypatch):
    """All dimensions and numbers of levels in one pass; beyond WHOLE rows by bins, with the same result."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("by dimension", "")
    books = kmeans.per_dimension(table, [1, 2], "lloyd")
    jobs = len(tracker.getJobIdsForGroup("by dimension"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 12
    monkeypatch.setattr(codebooks, "WHOLE", 100)
    by_bins = kmeans.per_dimension(table, [1, 2], "lloyd", of=[1, 2, 0, 2, 1, 2])
    assert sorted(by_bins) == [(0, 1), (1, 2), (3, 2), (4, 1), (5, 2)]
    assert all(np.allclose(c, books[key], rtol=1e-9, atol=1e-9) for key, c in by_bins.items())


def test_passes_send_bounded_tables(table, monkeypatch):
    """However many bins are to be split, a pass counts about COUNTS of them."""
    monkeypatch.setattr(codebooks, "COUNTS", 600)
    bins = codebooks.Bins(table)
    assert sum(len(t) for t in bins.tables) <= 610
    got = codebooks.lloyd(bins, 5)
    assert np.allclose(got[0], kmeans.lloyd_1d(values()[:, 0], 5)[0], atol=1e-6)
