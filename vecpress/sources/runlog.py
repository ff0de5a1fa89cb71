"""The run log: one appended row for each run, metrics and configuration as JSON text."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PATH = "logs/runs"
SCHEMA = "id string, timestamp string, git_branch string, git_commit string, package_version string, method string, dataset string, cli_command string, metrics_json string, config_json string, sweep_id string"


def log_path(path: str | None = None) -> str:
    return path or os.environ.get("DB_PATH") or DEFAULT_PATH


def _git(*args: str) -> str | None:
    done = subprocess.run(["git", *args], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def plain(value):
    """numpy scalars and arrays as JSON values."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def log_run(spark: SparkSession, method: str, dataset: str, metrics: dict, config: dict | None = None, sweep_id: str | None = None, path: str | None = None) -> None:
    now = datetime.now(UTC)
    row = (
        now.strftime("%Y%m%d%H%M%S%f"), now.isoformat(timespec="seconds"), _git("rev-parse", "--abbrev-ref", "HEAD"), _git("rev-parse", "--short", "HEAD"), "0.1.0",
        method, dataset, " ".join(sys.argv), json.dumps(plain(metrics)), json.dumps(plain(config or {})), sweep_id,
    )
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(log_path(path))


def load_runs(spark: SparkSession, path: str | None = None, sweep_id: str | None = None) -> DataFrame:
    """Latest first."""
    runs = spark.read.option("mergeSchema", "true").parquet(log_path(path))
    runs = runs.where(F.col("sweep_id") == sweep_id) if sweep_id else runs
    return parsed(runs).orderBy(F.col("timestamp").desc())


def parsed(runs: DataFrame) -> DataFrame:
    """The log with `metrics` as a map of numbers."""
    return runs.withColumn("metrics", F.from_json("metrics_json", "map<string,double>"))


def metric(name: str, default: float = 0.0) -> F.Column:
    return F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(default))


def rank_metric() -> F.Column:
    """The first metric whose name begins with rank_distortion@, and null without one."""
    found = F.map_filter("metrics", lambda k, _: k.startswith("rank_distortion@"))
    return F.get(F.map_values(found), F.lit(0))


def pending(cells: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a sweep that a checkpoint does not have yet."""
    return cells.join(done.select(*keys).distinct(), keys, "left_anti")
