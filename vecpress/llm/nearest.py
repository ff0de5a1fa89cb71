"""Nearest neighbours by a block matrix join in int8 with error bounds.

Queries and candidates are dealt to the cells of a grid: strip r of the candidates meets
strip c of the queries in cell (r, c), so a record is sent once for each strip of the other
side. Strips have a bounded number of rows, whatever the table's size. In a cell vectors are
quantised to int8, x = s q + e with |e| measured, and tiles of integer products give
approximate distances d; the triangle inequality bounds the true distance by d - |e_x| - |e_y|
and d + |e_x| + |e_y|. Both bounds are widened by what rounding may add to them: d is the root
of a difference of numbers as large as the squared norms, so its error follows those and not
d (`ROUND`). Pairs whose lower bound passes the k-th smallest upper bound of their query cannot
be among its k nearest; the others are computed again in double precision on the original
vectors. A task keeps one heap of k for each query of the strip it is at, and the heaps of all
tasks are merged by heaps of k. The result is exact: nothing is lost to quantisation.

Defined cases: vectors that are null, empty, all zero, or hold a null, a NaN or an infinity
take no part, nor do rows with a null id. A distance whose square passes the largest double is
infinite: such rows come last, by id. Vectors are compared with those of their own
length. Rows that repeat an id count once: as a query the first by vector, as a candidate the
nearest. Ties go to the smaller id. With fewer than k candidates all are returned. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 10
#: Rows of a strip of queries, and of candidates, on average.
QUERY_STRIP = 4096
CANDIDATE_STRIP = 16384
#: Partitions at most; with more cells a task takes several, one after another.
PARTS = 20_000
#: Dimensions whose int8 products a float32 sum holds exactly: 127 * 127 * 1024 < 2**24.
EXACT_DIMS = 1024
#: Rounding unit of doubles, and a length below which squares lose their digits.
ROUND = float(np.finfo(np.float64).eps)
FAINT = 1e-150


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, bounds on the norms of what is lost, and the squared norms of
    the quantised rows."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    norm2 = (q.astype(np.float64) ** 2).sum(axis=1) * scale**2
    lost = np.sqrt(((x - near) ** 2).sum(axis=1))
    return q, scale, lost * (1 + x.shape[1] * ROUND) + 8 * ROUND * np.sqrt((x**2).sum(axis=1)) + FAINT, norm2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 multiplies hold the sums of EXACT_DIMS."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T
    return out


def exact_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, the squares summed in order of dimension."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for d in range(x.shape[1]):
            total += (x[:, d] - y[:, d]) ** 2
    return np.sqrt(total)


def cell_pairs(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, kth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, id, distance) of the pairs that may be among the k nearest.

    kth: the k-th distance that each query is already sure of; lowered as tiles are seen.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        qq, qs, qe, qn = quantise(queries)
        rel = (queries.shape[1] + 16) * ROUND  # of a computed distance
        for i in range(0, len(rows), 4096):
            part, own = rows[i : i + 4096], ids[i : i + 4096]
            cq, cs, ce, cn = quantise(part)
            distinct = len(np.unique(own)) == len(own)
            for j in range(0, len(queries), 1024):
                sl = slice(j, j + 1024)
                size = qn[sl, None] + cn[None, :]
                d2 = size - 2 * qs[sl, None] * cs[None, :] * products(qq[sl], cq)
                off, err = 32 * ROUND * size, qe[sl, None] + ce[None, :]
                same = query_ids[sl, None] == own[None, :]
                if len(own) > k and distinct:
                    high = (np.sqrt(np.maximum(d2 + off, 0)) + err) * (1 + rel)
                    high[same | np.isnan(high)] = np.inf
                    kth[sl] = np.minimum(kth[sl], np.partition(high, k - 1, axis=1)[:, k - 1])
                low = (np.sqrt(np.maximum(d2 - off, 0)) - err) * (1 - rel)
                a, b = np.nonzero(~(low > kth[sl, None]) & ~same)  # bounds that overflowed (NaN) keep their pair
                for m in range(0, len(a), 65536):
                    x, y = a[m : m + 65536] + j, b[m : m + 65536]
                    yield x, own[y], exact_distance(queries[x], part[y])


class Nearest:
    """One heap of the k nearest for each query; an id counts once."""

    def __init__(self, k: int):
        self.k = k
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def add(self, query: int, distance: float, vec_id: int) -> None:
        heap = self.heaps.setdefault(query, [])
        entry = (-distance, -vec_id)
        if len(heap) >= self.k and entry <= heap[0]:
            return
        for at, (d, v) in enumerate(heap):
            if v == -vec_id:
                if -distance > d:
                    heap[at] = entry
                    heapq.heapify(heap)
                return
        heapq.heappush(heap, entry)
        if len(heap) > self.k:
            heapq.heappop(heap)

    def kth(self, query: int) -> float:
        heap = self.heaps.get(query, ())
        return -heap[0][0] if len(heap) >= self.k else np.inf

    def rows(self) -> Iterator[tuple[int, int, int, float]]:
        for query, heap in self.heaps.items():
            for rank, (d, v) in enumerate(sorted(heap, reverse=True), 1):
                yield query, rank, -v, -d


def _tables(best: Nearest) -> Iterator[pa.RecordBatch]:
    rows = list(best.rows())
    for a in range(0, len(rows), 65536):
        part = rows[a : a + 65536]
        columns = [pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])


def search(queries: DataFrame, candidates: DataFrame, k: int = K, query_strip: int = QUERY_STRIP, candidate_strip: int = CANDIDATE_STRIP) -> DataFrame:
    """queries, candidates: (vec_id, v) as from `usable`. (query_id, rank, vec_id, score) of each
    query's k nearest other ids."""
    firsts = queries.groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    firsts = firsts.groupBy("vec_id").agg(F.min_by("v", "dim").alias("v"))
    across = max(1, -(-queries.count() // query_strip))
    down = max(1, -(-candidates.count() // candidate_strip))
    strip = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("r", strip(down, 5)).withColumn("c", every(across)).withColumn("side", F.lit(1))
    right = firsts.withColumn("c", strip(across, 6)).withColumn("r", every(down)).withColumn("side", F.lit(0))
    cells = left.select("r", "c", "side", "vec_id", "v").unionByName(right)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by strip of queries, then by strip of candidates, a cell's queries first;
        candidates are taken batch by batch. Heaps go out when a strip of queries ends."""
        best, cell, held, kths = Nearest(k), None, {}, {}
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("c", "r", "side")], 1)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), tuple(key[a, :2])
                if now != cell:
                    if cell is not None and now[0] != cell[0]:
                        yield from _tables(best)
                        best = Nearest(k)
                    cell, held, kths = now, {}, {}
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                sizes = part.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    at = sizes == dim
                    v = part.column("v").filter(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    if key[a, 2] == 0:
                        old = held.get(dim)
                        held[dim] = (np.concatenate([old[0], ids[at]]), np.concatenate([old[1], v])) if old else (ids[at], v)
                        kths.pop(dim, None)
                    elif dim in held:
                        query_ids, q = held[dim]
                        kth = kths.setdefault(dim, np.array([best.kth(x) for x in query_ids.tolist()]))
                        for x, y, d in cell_pairs(q, query_ids, v, ids[at], k, kth):
                            for query, vec, dist in zip(query_ids[x].tolist(), y.tolist(), d.tolist(), strict=True):
                                best.add(query, dist, vec)
                        kths[dim] = np.minimum(kth, [best.kth(x) for x in query_ids.tolist()])
        yield from _tables(best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(k)
        for batch in batches:
            for query, _, vec, dist in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                best.add(query, dist, vec)
        yield from _tables(best)

    schema = "query_id long, rank int, vec_id long, score double"
    parts = max(1, min(down * across, PARTS))
    met = cells.repartition(parts, "r", "c").sortWithinPartitions("c", "r", "side").mapInArrow(meet, schema)
    return met.repartition("query_id").mapInArrow(merge, schema)


def digest(embeddings: DataFrame) -> DataFrame:
    """The query op5: rows whose vec_id is divisible by 100 against all rows."""
    rows = usable(embeddings)
    return search(rows.where("vec_id % 100 = 0"), rows)


#: DuckDB SQL for the same rows (vectors of equal length).
ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
