"""Reports over tables of study results: method, bpd, compression, recall, mse and the like.

These tables have a row for each run, so single-partition windows are fine only where a
method or bpd partitions them; frontiers and ranges over all runs use grouped maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto_frontier(runs: DataFrame, gain_a: str = "compression", gain_b: str = "recall") -> DataFrame:
    """Runs that no other run beats strictly in both."""
    a, b = runs.alias("a"), runs.select(F.col(gain_a).alias("__a"), F.col(gain_b).alias("__b")).distinct().alias("b")
    return a.join(b, (F.col("__a") > F.col(f"a.{gain_a}")) & (F.col("__b") > F.col(f"a.{gain_b}")), "left_anti")


def radar_normalised(runs: DataFrame, gains: list[str], losses: list[str]) -> DataFrame:
    """Each method's means, scaled by the range over all runs; losses are turned round. 0 where
    all runs are equal."""
    names = [*gains, *losses]
    means = runs.dropna(subset=names).groupBy("method").agg(*(F.avg(c).alias(c) for c in names))
    limits = runs.dropna(subset=names).agg(*(f(c).alias(f"__{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))))
    both = means.crossJoin(F.broadcast(limits))  # one row

    def scaled(c: str):
        x = (F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0.0))
        return F.coalesce(1 - x if c in losses else x, F.lit(0.0)).alias(c)

    return both.select("method", *(scaled(c) for c in names))


def tradeoff_series(runs: DataFrame, x: str, y: str) -> DataFrame:
    """(method, position, x, y) of runs that have both, by x within the method."""
    order = F.row_number().over(Window.partitionBy("method").orderBy(x, y))
    return runs.dropna(subset=[x, y]).select("method", order.alias("position"), F.col(x).alias("x"), F.col(y).alias("y"))


def pivot(runs: DataFrame, value: str, methods: list[str]) -> DataFrame:
    """One row for each bpd, one column for each method."""
    return runs.groupBy("bpd").pivot("method", methods).agg(F.avg(value))


def keep_last(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last run of each key, by `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return runs.withColumn("__r", rank).where("__r = 1").drop("__r")


def best_in_bands(runs: DataFrame, bands: list[tuple[str, float, float]], gain: str = "recall") -> DataFrame:
    """(band, method, compression, gain) of the best run of each compression band."""
    table = runs.sparkSession.createDataFrame(bands, "band string, low double, high double")
    inside = runs.join(F.broadcast(table), F.col("compression").between(F.col("low"), F.col("high")))
    best = F.max_by(F.struct("method", "compression", gain), F.struct(F.col(gain), F.col("compression"), F.col("method")))
    return inside.groupBy("band").agg(best.alias("b")).select("band", "b.method", "b.compression", f"b.{gain}")


def method_ratio(runs: DataFrame, over: str, under: str, value: str = "mse") -> DataFrame:
    """Ratio of two methods at each bpd that both have."""
    a = runs.where(F.col("method") == over).select("bpd", F.col(value).alias("a"))
    b = runs.where(F.col("method") == under).select("bpd", F.col(value).alias("b"))
    return a.join(b, "bpd").select("bpd", (F.col("a") / F.col("b")).alias("ratio"), (F.col("a") - F.col("b")).alias("delta"))


def attribution(runs: DataFrame, baseline: str, first: str, second: str, both: str, value: str = "mse") -> DataFrame:
    """At each bpd, what each of two changes and both together take off the baseline, and the rest."""
    at = lambda m: F.max(F.when(F.col("method") == m, F.col(value)))
    wide = runs.groupBy("bpd").agg(at(baseline).alias("o"), at(first).alias("a"), at(second).alias("b"), at(both).alias("ab")).dropna()
    return wide.select("bpd", (F.col("o") - F.col("a")).alias("first"), (F.col("o") - F.col("b")).alias("second"), (F.col("o") - F.col("ab")).alias("both"), (F.col("a") + F.col("b") - F.col("o") - F.col("ab")).alias("interaction"))


def monotone_breaks(runs: DataFrame, value: str = "mse", falling: bool = True) -> DataFrame:
    """(method, bpd, value, next) where the value at the next bpd does not fall (or rise)."""
    later = F.lead(value).over(Window.partitionBy("method").orderBy("bpd"))
    wrong = F.col("later") >= F.col(value) if falling else F.col("later") <= F.col(value)
    return runs.withColumn("later", later).where(wrong).select("method", "bpd", F.col(value).alias("value"), F.col("later").alias("next"))


def sanity(runs: DataFrame, values: list[str]) -> DataFrame:
    """Counts of null, NaN or infinite entries, and of recalls beyond 0 to 1."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    count = lambda e: F.coalesce(F.sum(e.cast("long")), F.lit(0))
    return runs.agg(F.count("*").alias("n"), *(count(bad(c)).alias(f"bad_{c}") for c in values), count((F.col("recall") < 0) | (F.col("recall") > 1)).alias("recall_out"))


def by_method(runs: DataFrame, values: list[str]) -> DataFrame:
    """Mean, median, p95, largest and deviation of each value, by method, over runs that have all."""
    stats = [f.alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg(c)), ("median", F.percentile(c, F.lit(0.5))), ("p95", F.percentile(c, F.lit(0.95))), ("max", F.max(c)), ("std", F.stddev_pop(c)))]
    return runs.dropna(subset=values).groupBy("method").agg(*stats)


def ratio_summary(rows: DataFrame, ratio: str = "ratio", weight: str = "weight") -> DataFrame:
    """Weighted and plain mean of a ratio, median, p95, largest, and the share above 1.01."""
    r, w = F.col(ratio), F.col(weight)
    return rows.agg(
        (F.sum(r * w) / F.sum(w)).alias("weighted"), F.avg(r).alias("mean"), F.percentile(ratio, F.lit(0.5)).alias("median"),
        F.percentile(ratio, F.lit(0.95)).alias("p95"), F.max(r).alias("max"), F.avg((r > 1.01).cast("double")).alias("share_above"),
    )


def top_runs(runs: DataFrame, order: F.Column, n: int = 10) -> DataFrame:
    return runs.orderBy(order.desc(), "method", "bpd").limit(n)


def comparison_table(runs: DataFrame) -> DataFrame:
    """One line of text for each run; missing numbers are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    line = F.format_string("%-12s %8.2f %10.4f %12.6f", F.col("method"), zero("compression"), zero("recall"), zero("mse"))
    return runs.select("method", "bpd", line.alias("line"))
