"""Vector files as a Spark data source: `spark.read.format("vectorfile")` and `df.write.format("vectorfile")`.

A file holds records of an int32 length and that many float32 or int32 values, little-endian. All
records of a file have the first one's length, so the place of each is known and a file is read as
byte ranges of whole records, by as many tasks as its size asks for; only the first four bytes of
each file are looked at beforehand. Ids are record numbers, files in order of their names. Writing
makes a folder: each task writes its rows as a file of its own beside the others and the job's
commit moves the files of the tasks that count into place, in order of partition, so a task that
fails or runs twice leaves nothing.

Options: kind f (float32) or i (int32); strict true: a record of another length is an error
(false: lengths after the first are not looked at). Paths go through pyarrow's filesystems, which
the driver's planner and every executor open: shared folders, hdfs, s3 and others.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads, and bytes of them that it holds at a time.
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20
_HIDDEN = ("_", ".")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def reachable(path: str) -> bool:
    """Whether pyarrow has a filesystem for the path."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def files(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder by name; hidden ones are left out."""
    found = store.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(found.path, found.size)]
    inside = store.get_file_info(fs.FileSelector(path))
    return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(_HIDDEN))


def shape(store: fs.FileSystem, path: str, size: int) -> tuple[int, int]:
    """(rows, values a record) of a file."""
    if size == 0:
        return 0, 0
    with store.open_input_file(path) as file:
        head = file.read(4)
    dims = int(np.frombuffer(head, "<i4")[0]) if len(head) == 4 else 0
    if dims <= 0:
        raise ValueError(f"{path}: a record of {dims} values")
    if size % (4 * (dims + 1)):
        raise ValueError(f"{path}: the file does not end with a whole record")
    return size // (4 * (dims + 1)), dims


@dataclass
class Range(InputPartition):
    path: str
    dims: int
    first_id: int
    first: int  # record in the file
    rows: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, strict: bool):
        self.path, self.kind, self.strict = path, kind, strict

    def partitions(self) -> list[Range]:
        store, path = opened(self.path)
        found = files(store, path)
        with ThreadPoolExecutor(16) as pool:
            shapes = list(pool.map(lambda f: shape(store, *f), found))
        out, before = [], 0
        for (name, _), (rows, dims) in zip(found, shapes, strict=True):
            each = max(1, RANGE_BYTES // (4 * (dims + 1)))
            out += [Range(name, dims, before + i, i, min(each, rows - i)) for i in range(0, rows, each)]
            before += rows
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = opened(self.path)
        record = 4 * (partition.dims + 1)
        step = max(1, CHUNK_BYTES // record)
        kind = (pa.float32(), "<f4") if self.kind == "f" else (pa.int32(), "<i4")
        with store.open_input_file(partition.path) as file:
            file.seek(partition.first * record)
            for i in range(0, partition.rows, step):
                n = min(step, partition.rows - i)
                rows = np.frombuffer(file.read(n * record), "<i4").reshape(n, partition.dims + 1)
                if self.strict and (rows[:, 0] != partition.dims).any():
                    raise ValueError(f"{partition.path}: records differ in length")
                values = pa.array(np.ascontiguousarray(rows[:, 1:]).view(kind[1]).ravel(), kind[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.dims), values)
                ids = pa.array(np.arange(partition.first_id + i, partition.first_id + i + n))
                yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    partition: int


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.dtype, self.overwrite = path, "<f4" if kind == "f" else "<i4", overwrite
        self.attempt = uuid.uuid4().hex

    def _folder(self, path: str) -> str:
        return f"{path.rstrip('/')}/_writing-{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = opened(self.path)
        name, out, dims = f"{self._folder(path)}/{context.partitionId()}-{context.taskAttemptId()}", None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("embedding"))
            lengths = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([-1])
            dims = int(lengths[0]) if dims is None else dims
            if (lengths != dims).any() or dims <= 0:
                raise ValueError("vectors of a file are of one length")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(-1, dims)
            if out is None:
                store.create_dir(self._folder(path), recursive=True)
                out = store.open_output_stream(name)
            out.write(np.concatenate([np.full((len(values), 1), dims, "<i4"), values.view("<i4")], axis=1).tobytes())
        if out is not None:
            out.close()
        return Written(name if out is not None else None, context.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        old = files(store, path)
        if self.overwrite:
            for name, _ in old:
                store.delete_file(name)
        start = 0 if self.overwrite else len(old)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, f"{path.rstrip('/')}/part-{start + m.partition:06d}-{self.attempt[:8]}.{'f' if self.dtype == '<f4' else 'i'}vecs")
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(self._folder(path)).type != fs.FileType.NotFound:
            store.delete_dir(self._folder(path))


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    @property
    def _kind(self) -> str:
        kind = self.options.get("kind", "f")
        if kind not in ("f", "i"):
            raise ValueError("kind is f or i")
        return kind

    def schema(self) -> str:
        return f"vec_id long, embedding array<{'float' if self._kind == 'f' else 'int'}>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], self._kind, self.options.get("strict", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], self._kind, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """One file of the files of a folder, in order of their names. Where the store is a file system
    each task writes its files at their own places; elsewhere one task writes them one by one."""
    store, inside = opened(folder)
    target_store, target = opened(path)
    parts, at = [], 0
    for name, size in files(store, inside):
        parts.append((name, at, size))
        at += size
    local = isinstance(target_store, fs.LocalFileSystem)
    with target_store.open_output_stream(target) as out:
        if local and at:
            out.write(b"")
    if local and at:
        os.truncate(target, at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        store, _ = opened(folder)
        target_store, target = opened(path)
        out = None if local else target_store.open_output_stream(target)
        for row in sorted(rows, key=lambda r: r["at"]):
            with store.open_input_file(row["name"]) as file:
                done = 0
                while data := file.read(CHUNK_BYTES):
                    if local:
                        place = os.open(target, os.O_WRONLY)
                        os.pwrite(place, data, row["at"] + done)
                        os.close(place)
                    else:
                        out.write(data)
                    done += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["files"])

    if parts:
        table = spark.createDataFrame(parts, "name string, at long, size long")
        table = table.repartition(min(len(parts), 1000), "name") if local else table.coalesce(1)
        table.mapInArrow(copy, "files long").agg({"files": "sum"}).collect()


def read(spark: SparkSession, path: str, kind: str = "f", strict: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("vectorfile").option("kind", kind).option("strict", str(strict)).load(path)


def write(x: DataFrame, path: str, vector_col: str = "embedding", id_col: str = "vec_id", kind: str = "f", mode: str = "overwrite", parts: int | None = None) -> None:
    """A folder of files, `parts` of them or as many as Spark makes of the rows' size, whose
    records are the rows in order of id."""
    from pyspark.sql import functions as F

    register(x.sparkSession)
    rows = x.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "f" else "array<int>").alias("embedding"))
    rows = (rows.repartitionByRange(parts, "vec_id") if parts else rows.repartitionByRange("vec_id")).sortWithinPartitions("vec_id")
    rows.write.format("vectorfile").option("kind", kind).mode(mode).save(path)
