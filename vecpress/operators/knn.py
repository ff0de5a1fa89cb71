"""Exact k nearest neighbours of query sets of any size against a table of any size.

Strips of queries meet strips of rows (`grid`); a task screens rows by a matrix product, tile by
tile, and keeps the k best of each query, scored again in plain order of dimension, so results do
not depend on the matrix library. The screen allows for what rounding may add to a product, which
follows the vectors' norms and not their distance. The k best of all strips meet by query in a
window with a limit, which Spark applies before and after its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.functions import distance
from vecpress.functions.arrays import reduce_tables, to_matrix
from vecpress.operators import grid

#: Queries that meet a batch of rows at a time.
TILE = 512
ROUND = float(np.finfo(np.float64).eps)

SCHEMA = "qid long, id long, score double"


#: Entries that are summed at a time, so that they stay in the cache.
SUMMED = 1 << 18


def ordered_sum(terms: np.ndarray) -> np.ndarray:
    """Row sums from the first column to the last."""
    total = np.zeros(len(terms))
    if terms.shape[1]:
        step = max(1, SUMMED // terms.shape[1])
        for i in range(0, len(terms), step):
            part, own = terms[i : i + step], total[i : i + step]
            if terms.shape[1] >= 256:
                own += np.cumsum(part, axis=1)[:, -1]
            else:
                for d in range(part.shape[1]):
                    own += part[:, d]
    return total


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ordered_sum((q - x) ** 2) if metric == "l2" else ordered_sum(q * x)


def _exact_pairs(metric: str, q: np.ndarray, m: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scores of the pairs (m, n), a part at a time."""
    out, step = np.empty(len(m)), max(1, SUMMED // max(1, q.shape[1]))
    for i in range(0, len(m), step):
        out[i : i + step] = _exact(metric, q[m[i : i + step]], x[n[i : i + step]])
    return out


def _cost(metric: str, q: np.ndarray, x: np.ndarray, x2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Costs, smaller is nearer, and how far off rounding may have put them. x2: the squared
    lengths of x, if they are known."""
    q2, x2 = (q**2).sum(1)[:, None], ((x**2).sum(1) if x2 is None else x2)[None, :]
    off = 4 * (q.shape[1] + 16) * ROUND * (q2 + x2)
    return (q2 + x2 - 2 * q @ x.T if metric == "l2" else -(q @ x.T)), off


def best(cost: np.ndarray, off: np.ndarray, k: int, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query number, row number) of all pairs that may be among each query's k of least cost.
    kth: costs that k rows of each query are known to keep."""
    high = cost + off
    most = np.partition(high, k - 1, axis=1)[:, k - 1] if k <= cost.shape[1] else np.full(len(cost), np.inf)
    most = most if kth is None else np.minimum(most, kth)
    return np.nonzero(~(cost - off > most[:, None]))


class Top:
    """The k ids of least cost of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.cost = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def kth(self, at: np.ndarray | slice) -> np.ndarray:
        return self.cost[at, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, cost: np.ndarray) -> None:
        if not len(q):
            return
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        ids, cost = np.concatenate([self.ids[rows].ravel(), ids]), np.concatenate([self.cost[rows].ravel(), cost])
        order = np.lexsort((ids, cost, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = order[place < self.k]
        self.ids[rows], self.cost[rows] = ids[keep].reshape(-1, self.k), cost[keep].reshape(-1, self.k)

    def batch(self, names: np.ndarray, sign: float) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(self.ids != np.iinfo(np.int64).max)
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(self.ids[a, b]), pa.array(sign * self.cost[a, b])], names=["qid", "id", "score"])


def meet(top: Top, metric: str, q: np.ndarray, at: np.ndarray, x: np.ndarray, ids: np.ndarray, div: np.ndarray | None = None, tile: int = TILE) -> None:
    """Scores queries number `at` against rows x and keeps the best, `tile` queries at a time."""
    x2 = (x**2).sum(1)
    for i in range(0, len(at), tile):
        own = at[i : i + tile]
        cost, off = _cost(metric, q[own], x, x2)
        if div is not None:
            cost, off = cost / div[None, :], off / div[None, :]
        a, b = best(cost, off, top.k, top.kth(own))
        for j in range(0, len(a), 1 << 16):
            m, n = own[a[j : j + (1 << 16)]], b[j : j + (1 << 16)]
            score = _exact_pairs(metric, q, m, x, n)
            score = score / div[n] if div is not None else score
            top.add(m, ids[n], score if metric == "l2" else -score)


def top(df: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """(qid, rk, id, score): the k best of each query, ties to the smaller id."""
    order = F.col("score").asc() if nearest_first else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, F.col("id")))
    return df.withColumn("rk", rank).where(F.col("rk") <= k).select("qid", "rk", "id", "score")


def nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "qid long, rk int, id long, score double")


class Nearest:
    """A strip's best rows by squared distance or inner product."""

    tile = TILE

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, metric: str, read: Callable[[pa.RecordBatch, int], np.ndarray], scale: str | None = None):
        self.names, self.q, self.metric, self.read, self.scale, self.top = names, q, metric, read, scale, Top(len(q), k)

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        ids = rows.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        div = rows.column(self.scale).to_numpy(zero_copy_only=False) if self.scale else None
        meet(self.top, self.metric, self.q, to, self.read(rows, cell), ids, div, self.tile)

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from self.top.batch(self.names, 1.0 if self.metric == "l2" else -1.0)


def search(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", decode: Callable[[pa.RecordBatch], np.ndarray] | None = None, scale: str | None = None, full: bool = False, strip: int | None = None) -> DataFrame:
    """Exact search. base: vec_id and v (or what `decode` makes rows of); queries: qid, q.

    metric l2 scores squared distances, ip inner products, largest first. `scale` names a
    column of base by which an inner product is divided (the normalised score). A base of fewer
    than k rows gives shorter results, or with `full` an error. strip: queries that meet the rows
    at a time, at most.
    """
    if k <= 0:
        return nothing(base)
    if full and base.limit(k).count() < k:
        raise ValueError(f"the table has fewer than {k} rows")

    def read(rows: pa.RecordBatch, cell: int) -> np.ndarray:
        return decode(rows) if decode else to_matrix(rows.column("v"))

    rows = base if decode else base.select("vec_id", "v", *[scale] * bool(scale))
    return top(grid.match(rows, queries, lambda names, q: Nearest(names, q, k, metric, read, scale), SCHEMA, strip=strip), k, metric == "l2")


class Measured:
    """A strip's best rows under any measure of all pairs; undefined ones come last."""

    tile = TILE

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], nearest_first: bool):
        self.names, self.q, self.pairs, self.sign, self.top = names, q, pairs, 1.0 if nearest_first else -1.0, Top(len(q), k)

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        ids, x = rows.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), to_matrix(rows.column("v"))
        for i in range(0, len(to), self.tile):
            own = to[i : i + self.tile]
            cost = self.sign * self.pairs(self.q[own], x)
            cost = np.where(np.isnan(cost), np.inf, cost)
            a, b = best(cost, np.zeros_like(cost), self.top.k, self.top.kth(own))
            for j in range(0, len(a), 1 << 16):
                m, n = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                self.top.add(own[m], ids[n], cost[m, n])

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from self.top.batch(self.names, self.sign)


def gower_spans(base: DataFrame) -> np.ndarray:
    """The span of each dimension's numbers, entries of zero or more; 0 without two of them."""

    def fold(m: np.ndarray) -> dict[str, np.ndarray]:
        numbers = np.where(m >= 0, m, np.nan)
        return {"low": np.where(np.isnan(numbers), np.inf, numbers).min(0), "high": np.where(np.isnan(numbers), -np.inf, numbers).max(0)}

    got = reduce_tables(base, fold, {"low": np.minimum, "high": np.maximum})
    return np.maximum(np.where(np.isfinite(got["low"]), got["high"] - np.where(np.isfinite(got["low"]), got["low"], 0), 0), 0)


def search_metric(base: DataFrame, queries: DataFrame, k: int, metric: str | int) -> DataFrame:
    """Search under any metric of `distance.PAIRWISE`, or `gower`, whose spans a first pass over
    base measures. A pair whose measure is undefined (no common dimension, a denominator of zero)
    comes last and has no finite score. Scores are summed in order of dimension, and a task keeps
    the k best rows of each query."""
    name = distance.metric(metric)
    if k <= 0:
        return nothing(base)
    nearest_first = name == "gower" or distance.METRICS[name][1]
    if name == "gower":
        spans = gower_spans(base)
        pairs = lambda q, x: distance.gower_pairs(q, x, spans)
    else:
        pairs = distance.PAIRWISE[name]
    return top(grid.match(base.select("vec_id", "v"), queries, lambda names, q: Measured(names, q, k, pairs, nearest_first), SCHEMA), k, nearest_first)


def normalised_ground_truth(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k by q.x / |x|, the norm floored."""
    normed = base.withColumn("norm", distance.floored_norm(F.col("v")))
    return search(normed, queries, k, "ip", scale="norm")


def wide(results: DataFrame) -> DataFrame:
    """(qid, ids): each query's ids, nearest first."""
    pairs = F.sort_array(F.collect_list(F.struct("rk", "id")))
    return results.groupBy("qid").agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))
