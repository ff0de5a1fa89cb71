"""Times at the size of the published figures: 99,000 vectors of 1536 dimensions, 1,000 queries.

The vectors are made by Spark (a falling spectrum, length one), as none of that size is given; each
step is timed once on local[$BENCH_CPUS]. Prints a line for each step and one JSON line at the end.
`python bench_wide.py [step ...]` runs some of the steps; see STEPS.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecpress.functions.arrays import map_batches, to_lists, vectors
from vecpress.operators import blocks, codecs, ivf, knn
from vecpress.plans import study
from vecpress.sources import datasets

N, DIMS, QUERIES = int(os.environ.get("WIDE_ROWS", "99000")), 1536, 1000


def made(spark: SparkSession, path: str) -> None:
    """Base and queries as Parquet; rows of one batch of ids come from one seed."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_numpy()
        spectrum = (1.0 + np.arange(DIMS)) ** -0.6
        rows = np.stack([np.random.default_rng(int(i)).standard_normal(DIMS) for i in ids]) * spectrum
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        return {"vec_id": batch.column(0), "embedding": to_lists(rows.astype(np.float32))}

    table = map_batches(spark.range(N + QUERIES).select(F.col("id").alias("vec_id")), run, "vec_id long, embedding array<float>")
    table.write.mode("overwrite").parquet(path)


def main(wanted: list[str]) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-wide-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = f"file://{shared}/wide"
    made(spark, path)
    table = vectors(spark.read.parquet(path))
    x, q = table.where(F.col("vec_id") < N), datasets.as_queries(table.where(F.col("vec_id") >= N))
    truth = knn.normalised_ground_truth(x, q, 100)
    cell = lambda method, bpd: (lambda: study.measure(x, q, truth_table, study.build(method, bpd, DIMS)))
    save = lambda df, name: df.write.mode("overwrite").parquet(f"file://{shared}/{name}")
    segmented = codecs.Segmented(4)

    def staged():
        return blocks.staged_search(segmented, spark.read.parquet(f"file://{shared}/blocks"), q, 100).count()

    local, product = codecs.Local(4), codecs.Product(96, 8, 2)
    steps = {
        "ground_truth": lambda: save(truth, "truth"),
        "lvq4_fit": lambda: local.fit(x),
        "lvq4_encode": lambda: save(local.encode(x), "lvq4"),
        "lvq4_search": lambda: ivf.flat_search(local, spark.read.parquet(f"file://{shared}/lvq4"), q, 100).count(),
        "saq4_fit": lambda: segmented.fit(x),
        "saq4_encode": lambda: save(segmented.encode(x), "saq4"),
        "saq4_blocks": lambda: save(blocks.to_blocks(segmented, spark.read.parquet(f"file://{shared}/saq4")), "blocks"),
        "saq4_staged_search": staged,
        "pq_fit": lambda: product.fit(x),
        "pq_encode": lambda: save(product.encode(x), "pq"),
        "pq_table_search": lambda: ivf.table_search(product, spark.read.parquet(f"file://{shared}/pq"), q, 100).count(),
        "study_sq8": cell("sq", 8),
        "study_lvq4": cell("lvq", 4),
        "study_saq4": cell("saq_paper", 4),
    }
    seconds: dict[str, float] = {}
    truth_table = truth
    for name, step in steps.items():
        if wanted and name not in wanted:
            continue
        if name.startswith("study"):
            truth_table = spark.read.parquet(f"file://{shared}/truth")
        began = time.perf_counter()
        got = step()
        seconds[name] = round(time.perf_counter() - began, 2)
        print(name, seconds[name], {k: v for k, v in got.items() if "recall" in k or k == "mse"} if isinstance(got, dict) else "", flush=True)
    print(json.dumps({"metric": "seconds", "rows": N, "dims": DIMS, "queries": QUERIES, "cpus": int(cpus), "steps": seconds}))


STEPS = "ground_truth lvq4_fit lvq4_encode lvq4_search saq4_fit saq4_encode saq4_blocks saq4_staged_search pq_fit pq_encode pq_table_search study_sq8 study_lvq4 study_saq4".split()

if __name__ == "__main__":
    main(sys.argv[1:])
