"""Vectors whose distances are lost in rounding: the pruning bounds must not lose a neighbour."""

import math

import numpy as np
import pytest

from vecpress.llm import nearest


def _exact(x, i, k):
    d = nearest.exact_distance(np.repeat(x[i : i + 1], len(x), 0), x)
    return sorted((float(t), j) for j, t in enumerate(d) if j != i)[:k]


def _found(x, queries, k):
    best = nearest.Nearest(k)
    kth = np.full(len(queries), np.inf)
    for q, v, d in nearest.cell_pairs(x[queries], np.array(queries), x, np.arange(len(x)), k, kth):
        for a, b, c in zip(q.tolist(), v.tolist(), d.tolist(), strict=True):
            best.add(queries[a], c, b)
    out = {}
    for q, _, v, d in best.rows():
        out.setdefault(q, []).append((d, v))
    return out


@pytest.mark.parametrize(("dims", "step"), [(4096, 0.1), (4096, 0.3), (16384, 0.1), (16384, 1 / 3), (512, 0.1)])
def test_fixed_point_vectors(dims, step):
    rng = np.random.default_rng(dims)
    base = rng.integers(-127, 128, dims).astype(float)
    base[0] = 127
    x = np.repeat(base[None], 101, 0)
    for i, d in enumerate(rng.choice(np.arange(1, dims), 100, replace=False), 1):
        x[i, d] += 1 if x[i, d] < 0 else -1
    x *= step
    assert _found(x, [0], 10) == {0: _exact(x, 0, 10)}


@pytest.mark.parametrize("offset", [1e4, 1e7])
def test_offset_vectors(offset):
    rng = np.random.default_rng(5)
    x = offset + rng.normal(0, 0.01, (300, 64))
    x[100:110] = x[7]
    assert _found(x, [0, 7, 100, 299], 10) == {i: _exact(x, i, 10) for i in (0, 7, 100, 299)}


@pytest.mark.parametrize("size", [1e160, 1e-170, 3e-320, 1e150, 1e-150])
def test_extreme_vectors(size):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16)) * size
    x[40:] = rng.normal(size=(20, 16))
    x[3] = x[2]
    with np.errstate(over="ignore"):
        want = {i: _exact(x, i, 10) for i in (0, 2, 50)}
    assert _found(x, [0, 2, 50], 10) == want


def test_overflowing_distances_come_last(spark):
    rows = [(0, [1e160, 1.0]), (1, [1e160, 2.0]), (2, [-1e160, 0.0]), (3, [1.0, 1.0]), (4, [2e160, 1.0])]
    df = nearest.usable(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int"))
    got = [tuple(r) for r in nearest.search(df.where("vec_id = 0"), df, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, math.inf), (0, 3, 3, math.inf), (0, 4, 4, math.inf)]
