"""Datasets: vectors, queries and ground truth, from folders, tables or text."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.functions.arrays import vectors
from vecpress.operators import knn
from vecpress.sources import fvecs

TRUTH_K = 100
#: Usual names of a text column, in order of preference.
TEXT_COLUMNS = ("passage", "text", "body", "document", "content")

_own_dir: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors share: under spark.checkpoint.dir. Where that is unset a
    local master gets a folder of its own; for a cluster it is an error."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="vecpress-")
        base = _own_dir
    return f"{base.rstrip('/')}/vecpress/{name}-{uuid.uuid4().hex}"


@dataclass
class Dataset:
    """vectors: (vec_id, v); queries: (qid, q); truth: (qid, rk, id, score) or None."""

    vectors: DataFrame
    queries: DataFrame
    truth: DataFrame | None = None
    metric: str = "l2"
    notes: dict = field(default_factory=dict)


def as_queries(x: DataFrame) -> DataFrame:
    return x.select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))


def first_queries(x: DataFrame, num_queries: int = 100) -> DataFrame:
    """The first rows are queries and stay in the table."""
    return as_queries(x.orderBy("vec_id").limit(num_queries))


def id_at(x: DataFrame, place: int) -> int:
    """The vec_id at a place, from 0, of all ids in rising order, whatever gaps they have: counts
    of 1,024 equal ranges, then of the ranges of the one that holds the place, to a single id."""
    low, high, rows = x.agg(F.min("vec_id"), F.max("vec_id"), F.count("vec_id")).head()
    if not 0 <= place < rows:
        raise ValueError(f"place {place} of {rows} rows")
    while low < high:
        width = (high - low) // 1024 + 1
        of = F.floor((F.col("vec_id").cast("decimal(38,0)") - low) / width).cast("long").alias("range")
        inside = x.where(F.col("vec_id").between(low, high))
        for r in sorted(inside.groupBy(of).count().collect()):
            if place < r["count"]:
                low, high = low + r["range"] * width, min(high, low + (r["range"] + 1) * width - 1)
                break
            place -= r["count"]
    return low


def holdout(x: DataFrame, num_queries: int) -> tuple[DataFrame, DataFrame]:
    """The num_queries largest ids are queries and leave the table; all of them, if there are no
    more. Rows that share an id stay together."""
    rows = x.count()
    if num_queries <= 0 or rows == 0:
        return x, as_queries(x.limit(0))
    edge = id_at(x, max(rows - num_queries, 0))
    return x.where(F.col("vec_id") < edge), as_queries(x.where(F.col("vec_id") >= edge))


def base_and_queries(x: DataFrame, base: int, queries: int) -> tuple[DataFrame, DataFrame]:
    """The `base` smallest ids, and the next `queries` ids; fewer, if there are no more."""
    rows = x.count()
    edge = F.lit(True) if base >= rows else F.col("vec_id") < id_at(x, base)
    end = F.lit(True) if base + queries >= rows else F.col("vec_id") < id_at(x, base + queries)
    return x.where(edge), as_queries(x.where(~edge & end))


def bundle(x: DataFrame, num_queries: int = 100, truth: bool = True, metric: str = "l2", k: int = TRUTH_K) -> Dataset:
    q = first_queries(x, num_queries)
    return Dataset(x, q, knn.search(x, q, k, metric) if truth else None, metric)


def dummy(spark: SparkSession, rows: int = 10_000, dims: int = 1024, seed: int = 42) -> DataFrame:
    """Normal vectors from a seed: each row from a generator of its own."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            m = [np.random.default_rng((seed, i)).standard_normal(dims) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.list_(pa.float64()))], names=["vec_id", "v"])

    return spark.range(rows).mapInArrow(make, "vec_id long, v array<double>")


def from_matrix(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A small matrix as a vector table."""
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.asarray(matrix, np.float64))], "vec_id long, v array<double>")


def load_folder(spark: SparkSession, path: str, num_queries: int = 1000) -> Dataset:
    """A folder with train.npy and queries.npy (without those: the last num_queries rows are
    held out) and maybe groundtruth.npy, or base.fvecs, query.fvecs and maybe
    groundtruth.ivecs. 'synthetic' is 2000 x 64 and 100 x 64 normal numbers."""
    if path == "synthetic":
        rng = np.random.default_rng(0)
        train, query = rng.standard_normal((2000, 64)), rng.standard_normal((100, 64))
        return Dataset(from_matrix(spark, train), as_queries(from_matrix(spark, query)))
    at = Path(path)
    if (at / "train.npy").exists():
        x = from_matrix(spark, np.load(at / "train.npy"))
        truth = next((_wide_truth(spark, np.load(at / n)) for n in ("groundtruth.npy", "ground_truth.npy") if (at / n).exists()), None)
        if (at / "queries.npy").exists():
            return Dataset(x, as_queries(from_matrix(spark, np.load(at / "queries.npy"))), truth)
        return Dataset(*holdout(x, num_queries), truth)
    if (at / "base.fvecs").exists():
        x, q = (vectors(fvecs.read(spark, str(at / n))) for n in ("base.fvecs", "query.fvecs"))
        gt = at / "groundtruth.ivecs"
        truth = None
        if gt.exists():
            truth = fvecs.read(spark, str(gt), "i").select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("p", "id"))
            truth = truth.select("qid", (F.col("p") + 1).alias("rk"), F.col("id").cast("long"))
        return Dataset(x, as_queries(q), truth)
    raise FileNotFoundError(f"{path} has neither train.npy nor base.fvecs")


def _wide_truth(spark: SparkSession, ids: np.ndarray) -> DataFrame:
    rows = [(q, r + 1, int(i)) for q, row in enumerate(ids) for r, i in enumerate(row)]
    return spark.createDataFrame(rows, "qid long, rk int, id long")


def read_collection(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, text) of tab-separated lines; those with fewer than two fields are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("id"), parts[1].alias("text"))
    return rows.limit(limit) if limit else rows


def text_column(df: DataFrame) -> DataFrame:
    """(text) of the first column with a usual name."""
    name = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of {TEXT_COLUMNS} among {df.columns}")
    return df.select(F.col(name).alias("text"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with vec_id: the place of each row, files by name. It does not depend on how
    files are split among tasks."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    at, firsts = 0, []
    for name, rows in sorted((r[0], r[1]) for r in df.groupBy("__file").count().collect()):  # one row a file
        firsts.append((name, at))
        at += rows
    table = spark.createDataFrame(firsts, "__name string, __first long")
    found = df.join(table, F.col("__file") == F.col("__name"))
    return found.withColumn("vec_id", F.col("__at") + F.col("__first")).drop("__file", "__at", "__name", "__first")


def embedding_table(spark: SparkSession, path: str, limit: int | None = None, columns: tuple[str, ...] = ("emb", "embedding", "vector")) -> DataFrame:
    """(vec_id, v) of a Parquet table of vectors; rows without an id are numbered by their place."""
    df = spark.read.parquet(path)
    name = next((c for c in columns if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of {columns} among {df.columns}")
    x = vectors(df if "vec_id" in df.columns else numbered(spark, path), name)
    return x.limit(limit) if limit else x


def openai_table(spark: SparkSession, path: str, dim: int = 1536, limit: int | None = None) -> DataFrame:
    """Vectors of an entity table by their width, 1536 or 3072."""
    if dim not in (1536, 3072):
        raise ValueError("dim must be 1536 or 3072")
    return embedding_table(spark, path, limit, ("openai", f"text-embedding-3-large-{dim}-embedding", "embedding"))


def encode_texts(texts: DataFrame, encoder, dims: int) -> DataFrame:
    """(vec_id, v): texts (vec_id, text) through `encoder(list of texts) -> matrix` by batch."""
    from vecpress.functions.arrays import map_batches, to_lists

    def run(b) -> dict:
        m = np.asarray(encoder(b.column("text").to_pylist()), np.float64).reshape(b.num_rows, dims)
        return {"vec_id": b.column("vec_id"), "v": to_lists(m)}

    return map_batches(texts.select("vec_id", "text"), run, "vec_id long, v array<double>")


# --- ground truth ------------------------------------------------------------------------


def precompute_truth(x: DataFrame, path: str, num_queries: int = 100, k: int = TRUTH_K, metric: str = "l2") -> DataFrame:
    """Exact results of the first rows, written as (qid, rk, id, score) and read back."""
    knn.search(x, first_queries(x, num_queries), k, metric).write.mode("overwrite").parquet(path)
    return x.sparkSession.read.parquet(path)


def cached_truth(spark: SparkSession, folder: str, key: tuple, make) -> DataFrame:
    """Results under a name made of key; `make` computes them if there are none."""
    path = f"{folder.rstrip('/')}/gt_" + "_".join(map(str, key))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- study configuration -----------------------------------------------------------------


@dataclass
class StudyConfig:
    """The names and defaults are those of the configuration files it reads."""

    name: str
    base: str
    queries: str
    methods: list[str]
    bpd: list[float]
    n_queries: int | None = None
    ks: list[int] = field(default_factory=lambda: [1, 10, 100])
    chunk_size: int = 50_000
    mse_sample: int = 100_000
    output_dir: str = "results"


def load_config(path: str) -> StudyConfig:
    """A study from a file of `key: value` lines with one nested `dataset`, lists in brackets or
    as `- item` lines; JSON works too."""
    raw = Path(path).read_text()
    data = json.loads(raw) if raw.lstrip().startswith("{") else _simple_yaml(raw)
    dataset = data.pop("dataset", {})
    keys = {"base_fvecs": "base", "query_fvecs": "queries"}
    flat = {keys.get(k, k): v for k, v in (dataset | data).items()}
    known = StudyConfig.__dataclass_fields__
    return StudyConfig(**{k: v for k, v in flat.items() if k in known})


def _scalar(text: str):
    text = re.sub(r"\s+#.*$", "", text).strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(t) for t in text[1:-1].split(",") if t.strip()]
    if text[:1] in "'\"" and text[:1] == text[-1:]:
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def _simple_yaml(raw: str) -> dict:
    out: dict = {}
    stack = [(-1, out)]
    last: tuple[dict, str] | None = None
    for line in raw.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, text = len(line) - len(line.lstrip()), line.strip()
        if text.startswith("- ") and last:
            own, key = last
            if not isinstance(own[key], list):
                own[key] = []
            own[key].append(_scalar(text[2:]))
            continue
        while indent <= stack[-1][0]:
            stack.pop()
        key, _, value = text.partition(":")
        own = stack[-1][1]
        if value.strip() and not value.strip().startswith("#"):
            own[key.strip()] = _scalar(value)
        else:
            own[key.strip()] = {}
            stack.append((indent, own[key.strip()]))
        last = (own, key.strip())
    return out


def timestamped(path: str, now: datetime | None = None) -> str:
    """stem_YYYYMMDD_HHMMSS.ext in UTC."""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{(now or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}{ext}"
