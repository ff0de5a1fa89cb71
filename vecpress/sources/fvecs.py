"""Vector files: records of an int32 length and that many float32 or int32, little-endian.

Files are read as byte ranges by the data source `vectorfile`. In a store that only Spark opens
each file is read whole by a task (Spark's binaryFile source). Ids are the record numbers in file
order, files by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.sources import vectorfile


def parse(data: bytes, kind: str = "<f4", strict: bool = True) -> np.ndarray:
    """The matrix of a file. Empty data is (0, 0). Strict: every record must have the first
    one's length; else only the total size is looked at."""
    if not data:
        if strict:
            return np.zeros((0, 0), kind)
        raise ValueError("empty file")
    dims = int(np.frombuffer(data[:4], "<i4")[0])
    if dims <= 0:
        raise ValueError(f"a record of {dims} values")
    if len(data) % (4 * (dims + 1)):
        raise ValueError("the file does not end with a whole record")
    rows = np.frombuffer(data, "<i4").reshape(-1, dims + 1)
    if strict and (rows[:, 0] != dims).any():
        raise ValueError("records differ in length")
    return rows[:, 1:].copy().view(kind)


def dump(matrix: np.ndarray, kind: str = "<f4") -> bytes:
    matrix = np.asarray(matrix)
    if matrix.ndim != 2:
        raise ValueError("only matrices are written")
    head = np.full((len(matrix), 1), matrix.shape[1], "<i4")
    return np.concatenate([head, np.ascontiguousarray(matrix, kind).view("<i4")], axis=1).tobytes()


def read(spark: SparkSession, path: str, kind: str = "f", strict: bool = True) -> DataFrame:
    """(vec_id, embedding) of a file or a folder of files; kind f (float32) or i (int32)."""
    if vectorfile.reachable(path):
        return vectorfile.read(spark, path, kind, strict)
    dtype, out = ("<f4", "array<float>") if kind == "f" else ("<i4", "array<int>")
    files = spark.read.format("binaryFile").load(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = parse(data.as_py(), dtype, strict)
                for i in range(0, len(matrix), 8192):
                    part = matrix[i : i + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(list(part))], names=["file", "at", "embedding"])

    found = files.select("path", "content").mapInArrow(rows, f"file string, at long, embedding {out}")
    sizes = [(r[0], r[1]) for r in files.select("path", "length").orderBy("path").collect()]  # one row a file
    if len(sizes) <= 1:
        return found.select(F.col("at").alias("vec_id"), "embedding")
    counts = {r[0]: r[1] for r in found.groupBy("file").count().collect()}
    before, at = [], 0
    for name, _ in sizes:
        before.append((name, at))
        at += counts.get(name, 0)
    firsts = spark.createDataFrame(before, "file string, first long")
    return found.join(F.broadcast(firsts), "file").select((F.col("at") + F.col("first")).alias("vec_id"), "embedding")


def write_bytes(spark: SparkSession, path: str, blocks: Iterable[bytes]) -> None:
    """One file from blocks of bytes, in any store that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for block in blocks:
            out.write(bytearray(block))
    finally:
        out.close()


def write(x: DataFrame, path: str, vector_col: str = "embedding", id_col: str = "vec_id", kind: str = "f") -> None:
    """One file of rows in order of id: written as a folder of parts by the tasks, which then put
    them together (`vectorfile.join_files`). No row passes the driver. `vectorfile.write` leaves
    the folder, which is read like one file."""
    spark = x.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    vectorfile.write(x, folder, vector_col, id_col, kind)
    vectorfile.join_files(spark, folder, path)
    store, inside = vectorfile.opened(folder)
    store.delete_dir(inside)
