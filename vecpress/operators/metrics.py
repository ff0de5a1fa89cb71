"""Evaluation metrics. Several definitions of one name coexist; each is an operator of its own.

Result tables are long: (qid, rk, id). `truth` and `found` may hold more than k ranks.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.functions import distance

PAIR_EPS = 1e-10


def _hits(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, hits, n_truth, n_found) of each query of truth."""
    a = truth.where(F.col("rk") <= k).select("qid", "id")
    b = found.where(F.col("rk") <= k).select("qid", "id").distinct()
    both = a.groupBy("qid").agg(F.count("*").alias("n_truth"))
    got = b.groupBy("qid").agg(F.count("*").alias("n_found"))
    hits = a.distinct().join(b, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(got, "qid", "left").join(hits, "qid", "left").select("qid", zero("hits"), "n_truth", zero("n_found"))


def recall_sweep(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Mean over queries of hits / k."""
    return _hits(truth, found, k).agg(F.lit(k).alias("k"), F.avg(F.col("hits") / k).alias("recall"))


def recall_study(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Mean over queries of hits / min(k, found, true); 0 where that is 0 or there is no query."""
    low = F.least(F.lit(k), "n_found", "n_truth")
    each = F.when(low > 0, F.col("hits") / low).otherwise(0.0)
    return _hits(truth, found, k).agg(F.lit(k).alias("k"), F.coalesce(F.avg(each), F.lit(0.0)).alias("recall"))


def recalls_study(truth: DataFrame, found: DataFrame, ks: Iterable[int]) -> DataFrame:
    """recall_study at several k in one pass: one row, a column recall_at_<k> for each."""
    a = truth.select("qid", "id", F.col("rk").alias("a"), F.lit(None).cast("int").alias("b"))
    b = found.select("qid", "id", F.lit(None).cast("int").alias("a"), F.col("rk").alias("b"))
    ranks = a.unionByName(b).groupBy("qid", "id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    within = lambda c, k: F.sum((c <= k).cast("long"))
    counts = [f(k).alias(f"{n}{k}") for k in ks for n, f in (("hits", lambda k: within(F.greatest("a", "b") + F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(None)).otherwise(0), k)), ("true", lambda k: within(F.col("a"), k)), ("got", lambda k: within(F.col("b"), k)))]
    each = ranks.groupBy("qid").agg(*counts).where(" or ".join(f"true{k} > 0" for k in ks))

    def mean(k: int):
        low = F.least(F.lit(k), F.coalesce(F.col(f"true{k}"), F.lit(0)), F.coalesce(F.col(f"got{k}"), F.lit(0)))
        return F.coalesce(F.avg(F.when(low > 0, F.coalesce(F.col(f"hits{k}"), F.lit(0)) / low).otherwise(0.0)), F.lit(0.0)).alias(f"recall_at_{k}")

    return each.agg(*(mean(k) for k in ks))


def recall_bench(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Hits of all queries over the sum of min(k, true)."""
    return _hits(truth, found, k).agg(F.lit(k).alias("k"), (F.sum("hits") / F.sum(F.least(F.lit(k), "n_truth"))).alias("recall"))


def recall_ivf(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Hits of all queries over queries times k."""
    return _hits(truth, found, k).agg(F.lit(k).alias("k"), (F.sum("hits") / (F.count("*") * k)).alias("recall"))


def rank_distortion(truth: DataFrame, found: DataFrame, k: int, num_queries: int | None = None) -> DataFrame:
    """True neighbours missing, over queries times k."""
    hits = _hits(truth, found, k)
    if num_queries is not None and hits.count() < num_queries:
        raise ValueError(f"fewer than {num_queries} queries have results")
    return hits.agg(F.lit(k).alias("k"), (F.sum(F.col("n_truth") - F.col("hits")) / (F.count("*") * k)).alias("rank_distortion"))


def rank_distortion_per_query(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    return _hits(truth, found, k).select("qid", ((F.col("n_truth") - F.col("hits")) / k).alias("rank_distortion"))


def _row_error() -> F.Column:
    return distance.squared_l2(F.col("v"), F.col("r"))


def distortion_per_vector(pairs: DataFrame) -> DataFrame:
    """Mean over rows (v, r) of the squared error of the row."""
    return pairs.agg(F.avg(_row_error()).alias("distortion"), F.count("*").alias("n"))


def mse_per_element(pairs: DataFrame) -> DataFrame:
    """Squared error over rows times dimensions; null without rows."""
    return pairs.agg((F.sum(_row_error()) / F.sum(F.size("v"))).alias("mse"))


def pairwise_distortion(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """|d' / (d + eps) - 1| over linked pairs (i, j) of rows: mean, median, p95, max, deviation.

    pairs: (vec_id, v, r); links: (i, j); those with i = j drop out.
    """
    a = pairs.select(F.col("vec_id").alias("i"), F.col("v").alias("va"), F.col("r").alias("ra"))
    b = pairs.select(F.col("vec_id").alias("j"), F.col("v").alias("vb"), F.col("r").alias("rb"))
    both = links.where("i <> j").join(a, "i").join(b, "j")
    ratio = distance.l2(F.col("ra"), F.col("rb")) / (distance.l2(F.col("va"), F.col("vb")) + PAIR_EPS)
    d = both.select(F.abs(ratio - 1).alias("e"))
    return d.agg(
        F.avg("e").alias("mean"), F.percentile("e", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.95)).alias("p95"),
        F.max("e").alias("max"), F.stddev_pop("e").alias("std"), F.count("*").alias("num_pairs"),
    )


def hashed_links(x: DataFrame, rows: int) -> DataFrame:
    """One partner for each id, by a fixed rule: (7919 id + 13) mod rows."""
    return x.select(F.col("vec_id").alias("i"), F.pmod(F.col("vec_id") * 7919 + 13, F.lit(rows)).alias("j"))


# --- sizes -------------------------------------------------------------------------------


def stored_bytes(codes: DataFrame, code: str = "code") -> DataFrame:
    return codes.agg(F.sum(F.octet_length(code)).alias("code_bytes"), F.sum(F.octet_length(code) + 4).alias("code_bytes_with_norm"))


def footprint(kind: str, n: int, dims: int, code_size: int = 0, cells: int = 0, bits: int = 8, bpd: float = 0) -> int:
    """Bytes an index of `kind` holds in memory."""
    rules = {
        "flat": n * code_size,
        "ivf": cells * dims * 4 + n * code_size,
        "ivfpq": cells * dims * 4 + n * code_size + dims * 2**bits * 4,
        "rabitq": n * code_size,
        "rabitq_ivf": n * code_size + 8 * n + cells * dims * 4,
        "saq": int(n * dims * bpd / 8) + cells * dims * 4,
    }
    return rules[kind]


def compression_factor(n: int, dims: int, code_bytes: int) -> float:
    return 4 * n * dims / code_bytes if code_bytes else float("inf")


# --- speed -------------------------------------------------------------------------------


def timed(run: Callable[[], object]) -> tuple[float, object]:
    """Seconds, and what run returned."""
    began = time.perf_counter()
    out = run()
    return time.perf_counter() - began, out


def qps_mean(run: Callable[[], object], queries: int, repeats: int = 3) -> tuple[float, float]:
    """Queries a second: mean and deviation over repeats."""
    if not queries:
        raise ValueError("no queries")
    rates = [queries / max(timed(run)[0], 1e-12) for _ in range(repeats)]
    return statistics.fmean(rates), statistics.pstdev(rates)


def qps_best(run: Callable[[], object], queries: int, repeats: int = 3) -> tuple[float, object]:
    """Queries a second of the fastest repeat, and its result."""
    best = min((timed(run) for _ in range(repeats)), key=lambda r: r[0])
    return queries / max(best[0], 1e-12), best[1]
