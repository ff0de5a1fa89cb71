"""Distances and scores between two array<double> columns, as plain column expressions.

Sums run in order of dimension in double precision, so a SQL engine that folds a list from
the left gets the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of norms that divide.
NORM_FLOOR = 1e-12


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def floored_norm(a: Column) -> Column:
    return F.greatest(norm(a), F.lit(NORM_FLOOR))


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def lp(a: Column, b: Column, p: float = 3.0) -> Column:
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def canberra(a: Column, b: Column) -> Column:
    """Terms with a zero denominator are zero."""
    return _fold(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))


def bray_curtis(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y)) / _fold(a, b, lambda x, y: F.abs(x + y))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Divergence of the absolute values as distributions."""
    p = F.transform(a, lambda x: F.abs(x))
    q = F.transform(b, lambda x: F.abs(x))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    sp, sq = total(p), total(q)

    def term(x: Column, y: Column) -> Column:
        u, v = x / sp, y / sq
        m = (u + v) / 2
        part = lambda w: F.when(w > 0, w * F.ln(w / m)).otherwise(0.0)
        return (part(u) + part(v)) / 2

    return _fold(p, q, term)


def jaccard(a: Column, b: Column) -> Column:
    """One less the sum of minima over the sum of maxima, of absolute values."""
    low = _fold(a, b, lambda x, y: F.least(F.abs(x), F.abs(y)))
    return 1 - low / _fold(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y)))


def nan_euclidean(a: Column, b: Column) -> Column:
    """Euclidean over the dimensions that both have, scaled up to all of them."""
    seen = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), 0.0).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    total = _fold(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), 0.0).otherwise((x - y) * (x - y)))
    return F.sqrt(total * F.size(a) / seen)


#: Name -> (expression, whether smaller is nearer).
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "l2": (squared_l2, True),
    "ip": (inner_product, False),
    "l1": (l1, True),
    "linf": (linf, True),
    "lp": (lp, True),
    "canberra": (canberra, True),
    "braycurtis": (bray_curtis, True),
    "jensenshannon": (jensen_shannon, True),
    "jaccard": (jaccard, True),
    "nan_euclidean": (nan_euclidean, True),
}

def _over(q: np.ndarray, x: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of terms of all pairs (queries, rows), from the first dimension to the last."""
    total = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        total += term(q[:, d, None], x[None, :, d])
    return total


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def _linf_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out = np.maximum(out, np.abs(q[:, d, None] - x[None, :, d]))
    return out


def _canberra_term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.abs(a) + np.abs(b)
    return np.where(size == 0, 0.0, np.abs(a - b) / np.where(size == 0, 1, size))


def _jensen_shannon_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    def shares(m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(m))
        for d in range(m.shape[1]):
            total += np.abs(m[:, d])
        return _divided(np.abs(m), np.repeat(total[:, None], m.shape[1], 1))

    def part(w: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(w > 0, w * np.log(np.where(w > 0, w, 1) / np.where(w > 0, m, 1)), np.where(np.isnan(w), np.nan, 0.0))

    return _over(shares(q), shares(x), lambda u, v: (part(u, (u + v) / 2) + part(v, (u + v) / 2)) / 2)


def _nan_euclidean_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    seen = _over(q, x, lambda a, b: 1.0 - (np.isnan(a) | np.isnan(b)))
    total = _over(q, x, lambda a, b: np.where(np.isnan(a) | np.isnan(b), 0.0, (a - b) * (a - b)))
    return np.sqrt(_divided(total * q.shape[1], seen))


def gower_pairs(q: np.ndarray, x: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Mean over the dimensions that both have of |a - b| over the dimension's span; entries below
    zero are categories, which differ by one or not at all, and a category differs by one from a
    number. spans: (dims,) of the table's numbers; a span of zero makes differences zero. A pair
    without a common dimension is NaN."""
    seen, total = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        a, b = q[:, d, None], x[None, :, d]
        both = ~(np.isnan(a) | np.isnan(b))
        numbers = (a >= 0) & (b >= 0)
        apart = np.minimum(np.abs(a - b) / spans[d], 1.0) if spans[d] > 0 else np.zeros_like(total)
        total += np.where(both, np.where(numbers, apart, np.where((a < 0) & (b < 0) & (np.trunc(a) == np.trunc(b)), 0.0, 1.0)), 0.0)
        seen += both
    return _divided(total, seen)


#: Name -> the same measures of all pairs of two matrices (queries, rows). NaN where one is undefined.
PAIRWISE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": lambda q, x: _over(q, x, lambda a, b: (a - b) * (a - b)),
    "ip": lambda q, x: _over(q, x, lambda a, b: a * b),
    "l1": lambda q, x: _over(q, x, lambda a, b: np.abs(a - b)),
    "linf": _linf_pairs,
    "lp": lambda q, x: _over(q, x, lambda a, b: np.abs(a - b) ** 3.0) ** (1.0 / 3.0),
    "canberra": lambda q, x: _over(q, x, _canberra_term),
    "braycurtis": lambda q, x: _divided(_over(q, x, lambda a, b: np.abs(a - b)), _over(q, x, lambda a, b: np.abs(a + b))),
    "jensenshannon": _jensen_shannon_pairs,
    "jaccard": lambda q, x: 1 - _divided(_over(q, x, lambda a, b: np.minimum(np.abs(a), np.abs(b))), _over(q, x, lambda a, b: np.maximum(np.abs(a), np.abs(b)))),
    "nan_euclidean": _nan_euclidean_pairs,
}

#: The numbers by which the metric may also be named.
METRIC_NUMBERS = {0: "ip", 1: "l2", 2: "l1", 3: "linf", 4: "lp", 20: "canberra", 21: "braycurtis", 22: "jensenshannon", 23: "jaccard", 24: "nan_euclidean", 25: "gower"}


def metric(name: str | int) -> str:
    """A metric's name from its number, or from its name in any case."""
    if isinstance(name, int) or str(name).isdigit():
        name = METRIC_NUMBERS.get(int(name), str(name))
    plain = str(name).strip().lower().removeprefix("metric_").replace("inner_product", "ip").replace("nan_euclidean", "naneuclidean")
    plain = "nan_euclidean" if plain == "naneuclidean" else plain
    if plain not in METRICS and plain != "gower":
        raise ValueError(f"unknown metric {name!r}")
    return plain
