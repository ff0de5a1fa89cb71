"""Per-dimension statistics, covariance and principal axes, in one pass of partial sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vecpress.functions.arrays import reduce_tables

VARIANCE_FLOOR = 1e-12


def dim_stats(x: DataFrame) -> dict[str, np.ndarray]:
    """n, mean, var (population), mn, mx of each dimension."""
    got = reduce_tables(
        x,
        lambda m: {"n": [len(m)], "total": m.sum(0), "mn": m.min(0), "mx": m.max(0)},
        {"n": np.add, "total": np.add, "mn": np.minimum, "mx": np.maximum},
    )
    n = got["n"][0]
    mean = got["total"] / n
    centred = reduce_tables(x, lambda m: {"sq": ((m - mean) ** 2).sum(0)}, {"sq": np.add})
    return {"n": n, "mean": mean, "var": centred["sq"] / n, "mn": got["mn"], "mx": got["mx"]}


def ranges(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = reduce_tables(x, lambda m: {"mn": m.min(0), "mx": m.max(0)}, {"mn": np.minimum, "mx": np.maximum})
    return got["mn"], got["mx"]


def mean(x: DataFrame) -> np.ndarray:
    got = reduce_tables(x, lambda m: {"n": [len(m)], "total": m.sum(0)}, {"n": np.add, "total": np.add})
    return got["total"] / got["n"][0]


def mean_cov(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance from sums and cross products."""
    got = reduce_tables(x, lambda m: {"n": [len(m)], "total": m.sum(0), "gram": m.T @ m}, {"n": np.add, "total": np.add, "gram": np.add})
    n, mu = got["n"][0], got["total"] / got["n"][0]
    return mu, got["gram"].reshape(len(mu), len(mu)) / n - np.outer(mu, mu)


def pca(x: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (columns, by falling variance; each one's largest entry positive), variances."""
    mu, cov = mean_cov(x)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    axes = axes[:, order]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mu, axes * np.where(signs == 0, 1, signs), np.maximum(values[order], VARIANCE_FLOOR)


def random_rotation(dims: int, seed: int) -> np.ndarray:
    """An orthogonal matrix from a seed; signs are fixed by a positive diagonal of R."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.where(np.diag(r) < 0, -1, 1)
