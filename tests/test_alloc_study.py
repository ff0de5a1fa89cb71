"""The allocation study against optimal codebooks and allocations found by trying all."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.operators import kmeans
from vecpress.plans import registry
from vecpress.sources import datasets


def least_errors(values, most):
    """Squared errors of the best 1..most cells, over all borders between sorted values."""
    v = np.sort(values)
    s1, s2 = (np.concatenate([[0.0], np.cumsum(v**p)]) for p in (1, 2))
    n = np.arange(len(v) + 1)
    size = np.maximum(n[None, :] - n[:, None], 1)
    cost = np.where(n[None, :] > n[:, None], np.maximum(s2[None, :] - s2[:, None] - (s1[None, :] - s1[:, None]) ** 2 / size, 0), np.inf)
    np.fill_diagonal(cost, 0)
    best, out = cost[0], [cost[0, -1]]
    for _ in range(most - 1):
        best = (best[:, None] + cost).min(0)
        out.append(best[-1])
    return np.array(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three dimensions whose means are not zero and from whose quantiles Lloyd's steps end in worse codebooks."""
    rng = np.random.default_rng(3)
    near = lambda sizes: np.concatenate([rng.normal(5 + 20 * i, 0.1, n) for i, n in enumerate(sizes)])
    rows = np.stack([rng.permutation(e) for e in (near([180, 30, 30]), near([20, 20, 160, 40]), rng.exponential(size=240) ** 3 + 1)], axis=1)
    path = str(tmp_path_factory.mktemp("tables"))
    datasets.from_matrix(spark, rows).select("vec_id", F.col("v").cast("array<float>").alias("embedding")).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_costs_are_those_of_exact_codebooks(spark, tables):
    v = np.array([r["v"] for r in registry._tapered(spark, tables).collect()])
    want = np.stack([least_errors(e, 32)[[0, 1, 3, 7, 15, 31]] for e in v.T])
    assert np.allclose(want[:, 0], v.var(0) * len(v))
    assert np.allclose(registry._cost_table(spark, tables), want, rtol=1e-7, atol=1e-7)


def test_allocations_are_scored_on_them(spark, tables):
    v = np.array([r["v"] for r in registry._tapered(spark, tables).collect()])
    costs = np.stack([least_errors(e, 32)[[0, 1, 3, 7, 15, 31]] for e in v.T])
    best = min(sum(costs[d, b] for d, b in enumerate(bits)) for bits in product(range(6), repeat=3) if sum(bits) <= 9)
    got = {r["method"]: r for r in registry.queries()["alloc_study"](spark, tables).collect()}
    assert sorted(got) == ["bennett", "greedy", "optimal"] and all(r["bits"] <= 9 for r in got.values())
    assert np.isclose(got["optimal"]["cost"], best, rtol=1e-7)
    assert all(r["cost"] >= best * (1 - 1e-9) for r in got.values())
    # Bennett's curve takes the variances: half a dimension's error goes with each bit
    bits, left = [0, 0, 0], 9
    while left:
        d = max((d for d in range(3) if bits[d] < 5), key=lambda d: (costs[d, 0] / 2 ** bits[d], -d))
        bits[d], left = bits[d] + 1, left - 1
    assert np.isclose(got["bennett"]["cost"], sum(costs[d, b] for d, b in enumerate(bits)), rtol=1e-7)


def test_exact_levels_of_near_ties(spark):
    """A lump between two others goes with either at nearly the same error: which is less hangs on values inside bins."""
    rng = np.random.default_rng(13)
    half = np.concatenate([rng.normal(4, 0.8, 4000), np.abs(rng.normal(0, 0.8, 2000))])
    v = np.concatenate([half, -half, [9.0 + rng.random(), 1e-4 * rng.standard_normal()]])
    s1, s2, n = np.cumsum(np.sort(v)), np.cumsum(np.sort(v) ** 2), np.arange(1, len(v))
    want = (s2[-1] - s1[:-1] ** 2 / n - (s1[-1] - s1[:-1]) ** 2 / (len(v) - n)).min()
    c = kmeans.per_dimension(datasets.from_matrix(spark, v[:, None]).repartition(3), [1], "exact")[0, 1]
    assert np.isclose(((v - c[kmeans.levels_of(v, c)]) ** 2).sum(), want, rtol=1e-10)


@pytest.mark.parametrize("kind", ["normal", "long tail", "grid", "clusters", "weights"])
def test_borders_narrowed_down_are_those_of_all_places(kind, monkeypatch):
    """With few groups of values for a level most places are ruled out; the optimum stays."""
    rng = np.random.default_rng(7)
    v = {"normal": rng.standard_normal(900), "long tail": rng.standard_cauchy(900), "grid": np.round(rng.standard_normal(900), 2), "clusters": np.concatenate([rng.normal(9 * i, 0.1 + i, 180) for i in range(5)]), "weights": rng.random(900)}[kind]
    w = rng.integers(1, 9, len(v)) if kind == "weights" else np.ones(len(v), int)
    monkeypatch.setattr(kmeans, "GROUPS", 8)
    ks = [1, 2, 3, 8, 16]
    want = least_errors(np.repeat(v, w), 16)
    for k, c in kmeans.exact_1d(v, ks, w).items():
        assert len(c) == k and np.isclose((w * (v - c[kmeans.levels_of(v, c)]) ** 2).sum(), want[k - 1], rtol=1e-9)
