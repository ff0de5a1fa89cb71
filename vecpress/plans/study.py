"""Studies: methods x bits a dimension, scored by exact search under the normalised inner product."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.functions import distance
from vecpress.functions.arrays import vectors
from vecpress.operators import allocation, codecs, ivf, kmeans, knn, metrics
from vecpress.sources import datasets, fvecs

KS = (1, 10, 100)

#: Method name -> codec for (bits a dimension, dimensions).
METHODS: dict[str, Callable[[float, int], codecs.Codec]] = {
    "pq": lambda bpd, dims: codecs.Product(allocation.subquantizers(bpd, dims), 8),
    "opq": lambda bpd, dims: codecs.OptimizedProduct(allocation.subquantizers(bpd, dims), 8),
    "sq": lambda bpd, dims: codecs.Scalar(allocation.scalar_bits(bpd)),
    "rabitq": lambda bpd, dims: codecs.MultiBit(int(bpd)) if bpd > 1 else codecs.SignBit(),
    "lvq": lambda bpd, dims: codecs.Local(int(bpd)),
    "saq_paper": lambda bpd, dims: codecs.Segmented(bpd, joint=True),
    "ours": lambda bpd, dims: codecs.Segmented(bpd, joint=False, codebook="lloyd"),
    "ours_exact": lambda bpd, dims: codecs.Segmented(bpd, joint=False, codebook="exact"),
    "rankaware": lambda bpd, dims: codecs.RankAware(bpd, 0.5, codebook="lloyd"),
    "perdim_mse": lambda bpd, dims: codecs.RankAware(bpd, 0.0, codebook="lloyd"),
    "rankaware_exact": lambda bpd, dims: codecs.RankAware(bpd, 0.5, codebook="exact"),
    "perdim_mse_exact": lambda bpd, dims: codecs.RankAware(bpd, 0.0, codebook="exact"),
}


def build(method: str, bpd: float, dims: int) -> codecs.Codec:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](bpd, dims)


def measure(x: DataFrame, queries: DataFrame, truth: DataFrame, codec: codecs.Codec, ks: Iterable[int] = KS, mse_sample: int | None = None) -> dict:
    """One cell: code bytes (with a 4-byte norm a row), compression, error and recalls. mse_sample:
    the error is that of about so many rows, drawn by a hash of the id, and not of all."""
    codec = codec.fit(x)
    ks = sorted(ks)
    pairs = codec.reconstruct(x)
    n = x.count()
    some = pairs if mse_sample is None else codec.reconstruct(kmeans.drawn(x, mse_sample, n))
    error, of = some.agg(F.coalesce(F.sum(distance.squared_l2(F.col("v"), F.col("r"))), F.lit(0.0)), F.count("*")).head()
    decoded = pairs.select("vec_id", F.col("r").alias("v"), distance.floored_norm(F.col("v")).alias("norm"))
    found = knn.search(decoded, queries, ks[-1], "ip", scale="norm")
    recalls = metrics.recalls_study(truth, found, ks).head().asDict()
    code_bytes = n * (codec.code_size() + codecs.NORM_BYTES)
    return {"code_bytes": code_bytes, "compression_factor": metrics.compression_factor(n, codec.dims, code_bytes), "mse": error / (of * codec.dims) if of else None, "n_db": n, "n_queries": queries.count(), "D": codec.dims} | recalls


def run_study(x: DataFrame, queries: DataFrame, methods: Iterable[str], bpds: Iterable[float], ks: Iterable[int] = KS, dataset: str = "", checkpoint: str | None = None, mse_sample: int | None = None) -> DataFrame:
    """A row for each (method, bpd). With a checkpoint folder each finished cell is written there,
    and a new run skips the cells that it finds. An unknown method or a failed cell raises after
    what came before it was written."""
    spark = x.sparkSession
    ks = sorted(ks)
    columns = ["dataset", "method", "bpd", "compression_factor", "code_bytes", "mse", "n_db", "n_queries", "D", "timestamp", *(f"recall_at_{k}" for k in ks)]
    schema = ", ".join(f"{c} {_kind(c)}" for c in columns)
    done: set[tuple[str, float]] = set()
    if checkpoint:
        target = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            done = {(r["method"], r["bpd"]) for r in spark.read.schema(schema).parquet(checkpoint).collect()}  # one row a cell
    x, queries = x.persist(), queries.persist()
    dims = x.select(F.size("v")).head()[0]
    truth = knn.normalised_ground_truth(x, queries, ks[-1]).persist()
    rows = []
    for method in methods:
        for bpd in map(float, bpds):
            if (method, bpd) in done:
                continue
            cell = measure(x, queries, truth, build(method, bpd, dims), ks, mse_sample)
            cell |= {"dataset": dataset, "method": method, "bpd": bpd, "timestamp": datetime.now(UTC).isoformat(timespec="seconds")}
            rows.append(tuple(cell[c] for c in columns))
            if checkpoint:
                spark.createDataFrame(rows[-1:], schema).coalesce(1).write.mode("append").parquet(checkpoint)
    truth.unpersist()
    queries.unpersist()
    x.unpersist()
    return spark.read.schema(schema).parquet(checkpoint) if checkpoint else spark.createDataFrame(rows, schema)


def run_config(spark: SparkSession, config: datasets.StudyConfig, checkpoint: str | None = None) -> DataFrame:
    """The study that a configuration file names: its vector files, the first n_queries of its
    queries, its methods and bits. chunk_size: rows that a batch holds while it runs; mse_sample:
    as in `measure`. Finished cells go to `checkpoint`, or cells below output_dir."""
    x = vectors(fvecs.read(spark, config.base))
    q = vectors(fvecs.read(spark, config.queries))
    q = datasets.first_queries(q, config.n_queries) if config.n_queries else datasets.as_queries(q)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(config.chunk_size))
    try:
        return run_study(x, q, config.methods, config.bpd, config.ks, config.name, checkpoint or f"{config.output_dir.rstrip('/')}/{config.name}/cells", config.mse_sample)
    finally:
        spark.conf.set(name, before)


def _kind(column: str) -> str:
    return {"dataset": "string", "method": "string", "timestamp": "string", "code_bytes": "long", "n_db": "long", "n_queries": "long", "D": "int"}.get(column, "double")


# --- index benches -----------------------------------------------------------------------


def index_methods(dims: int, bpd: int, cells: int = 64, nprobe: int = 8) -> dict[str, Callable]:
    """Name -> function of (x, queries, k) giving (results, bytes held)."""
    m = allocation.subquantizers_floor(bpd, dims)

    def flat(codec: codecs.Codec) -> Callable:
        def run(x: DataFrame, q: DataFrame, k: int):
            codec.fit(x)
            return ivf.flat_search(codec, codec.encode(x), q, k), metrics.footprint("flat", x.count(), dims, codec.code_size())

        return run

    def inverted(codec: codecs.Codec, kind: str, estimate: bool = False) -> Callable:
        def run(x: DataFrame, q: DataFrame, k: int):
            n = x.count()
            index = ivf.IVF(min(cells, max(1, n // 10)), codec).fit(x)
            held = metrics.footprint(kind, n, dims, codec.code_size(), index.cells, 8, bpd)
            return index.search(index.encode(), q, k, nprobe, estimate), held

        return run

    def sign(x: DataFrame, q: DataFrame, k: int):
        codec = codecs.SignBit().fit(x)
        return ivf.estimate_search(codec, codec.encode(x), q, k, 4), metrics.footprint("rabitq", x.count(), dims, codec.code_size())

    return {
        "pq_flat": flat(codecs.Product(m, 8)),
        "opq_flat": flat(codecs.OptimizedProduct(m, 8)),
        "sq_flat": flat(codecs.Scalar(allocation.scalar_bits_exact(bpd))),
        "lvq_flat": flat(codecs.Local(min(8, bpd))),
        "faiss_ivfpq": inverted(codecs.Product(m, 8), "ivfpq"),
        "saq": inverted(codecs.Segmented(bpd), "saq", True),
        "rabitq": sign,
        "rabitq_ivf": inverted(codecs.SignBit(), "rabitq_ivf", True),
    }


def compare(x: DataFrame, queries: DataFrame, methods: Iterable[str], bpd: int = 4, k: int = 10, cells: int = 64, nprobe: int = 8) -> DataFrame:
    """(method, recall_at_k, qps, memory_bytes, compression_ratio, k, N, D, error). Unknown methods
    are left out; one that fails leaves a row with nulls and its error."""
    spark = x.sparkSession
    dims, n = x.select(F.size("v")).head()[0], x.count()
    truth = knn.search(x, queries, k).persist()
    known = index_methods(dims, bpd, cells, nprobe)
    nq, rows = queries.count(), []
    for method in methods:
        if method not in known:
            continue
        try:
            found, held = known[method](x, queries, k)
            found = found.persist()
            seconds, _ = metrics.timed(lambda found=found: found.count())
            recall = metrics.recall_bench(truth, found, k).head()["recall"]
            found.unpersist()
            rows.append((method, recall, nq / seconds, held, metrics.compression_factor(n, dims, held), k, n, dims, None))
        except Exception as error:  # a bench goes on with the other methods
            rows.append((method, None, None, None, None, k, n, dims, f"{type(error).__name__}: {error}"[:2000]))
    truth.unpersist()
    return spark.createDataFrame(rows, "method string, recall_at_k double, qps double, memory_bytes long, compression_ratio double, k int, N long, D int, error string")


def sweep_bpd(x: DataFrame, queries: DataFrame, method: str, bpds: Iterable[int], k: int = 10) -> DataFrame:
    out = None
    for bpd in bpds:
        rows = compare(x, queries, [method], bpd, k).withColumn("bpd", F.lit(bpd))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- grids -------------------------------------------------------------------------------


def grid(method: str, subquantizers: str = "8,16,32", bits: str = "8", avg_bits: str = "4,8", metric: str = "L2") -> list[dict]:
    """Configurations of a sweep, from comma-separated lists."""
    ints = lambda s: [int(t) for t in s.split(",") if t.strip()]
    if method in ("pq", "opq"):
        return [{"method": method, "m": m, "bits": b} for m in ints(subquantizers) for b in ints(bits)]
    if method == "sq":
        return [{"method": "sq", "bits": 8} for b in ints(bits) if b == 8] or [{"method": "sq", "bits": 8}]
    if method == "rabitq":
        return [{"method": "rabitq", "metric": distance.metric(m)} for m in metric.split(",")]
    if method == "saq":
        return [{"method": "saq", "avg_bits": b, "joint": joint} for b in ints(avg_bits) for joint in (True, False)]
    raise ValueError(f"unknown method {method!r}")


def configured(config: dict) -> codecs.Codec:
    kinds = {"pq": codecs.Product, "opq": codecs.OptimizedProduct, "sq": codecs.Scalar, "rabitq": codecs.SignBit, "saq": codecs.Segmented}
    plain = ("method", "metric")[: 1 if config["method"] in ("rabitq", "saq") else 2]
    return kinds[config["method"]](**{k: v for k, v in config.items() if k not in plain})


def sweep(x: DataFrame, queries: DataFrame, configs: list[dict], k: int = 10, pairs: int = 1000) -> DataFrame:
    """For each configuration: compression, distortion, pairwise distortion, rank distortion, recall."""
    spark = x.sparkSession
    truth = knn.search(x, queries, max(k, 100)).persist()
    n, rows = x.count(), []
    for config in configs:
        codec = configured(config).fit(x)
        both = codec.reconstruct(x).persist()
        found = knn.search(both.select("vec_id", F.col("r").alias("v")), queries, max(k, 100)).persist()
        links = metrics.hashed_links(x.where(F.col("vec_id") < pairs), n)
        rows.append((
            config["method"], str(config), codec.compression_ratio(), metrics.distortion_per_vector(both).head()[0],
            metrics.pairwise_distortion(both, links).head()[0], metrics.rank_distortion(truth, found, k).head()[1],
            metrics.recall_sweep(truth, found, 10).head()[1], metrics.recall_sweep(truth, found, 100).head()[1],
        ))
        both.unpersist()
        found.unpersist()
    truth.unpersist()
    return spark.createDataFrame(rows, "method string, config string, compression double, reconstruction_distortion double, pairwise_mean double, rank_distortion double, recall_10 double, recall_100 double")
