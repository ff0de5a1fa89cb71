"""Between Arrow list columns and numpy matrices, for the operators that work on whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a kernel sees at a time.
ROWS = 4096


def vectors(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v array<double>) of a vector table; nulls take no part."""
    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def to_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix; others, and rows that are null, are an error. A
    null entry is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    if column.null_count or len(pc.unique(lengths)) > 1:
        raise ValueError(f"vectors of unequal length: {sorted(set(lengths.to_pylist()), key=str)[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def to_lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    values = pa.array(np.ascontiguousarray(matrix).ravel(), kind) if kind else pa.array(np.ascontiguousarray(matrix).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1] if len(matrix) else [0], pa.int32()), values)


def to_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of uint8 as BINARY."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def from_binary(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """df through fn, at most ROWS rows at a time; fn gives the columns of schema by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                out = fn(whole.slice(i, ROWS))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def reduce_tables(df: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], combine: dict[str, Callable], width: int = 16) -> dict[str, np.ndarray]:
    """Sums, minima and the like of fn(matrix) over all rows of df (vec_id, v).

    Each task sends one row of its partial results; `width` tasks combine those, and one task
    their rows, so the driver gets one row, as Arrow.
    """
    names = list(combine)

    def merge(parts: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for part in parts:
            total = part if total is None else [f(a, b) for f, a, b in zip(combine.values(), total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.ravel()], pa.list_(pa.float64())) for t in total], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list[np.ndarray]]:
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    out = fn(to_matrix(whole.slice(i, ROWS).column("v")))
                    yield [np.asarray(out[n], np.float64).ravel() for n in names]

        return merge(parts())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge([c.slice(i, 1).flatten().to_numpy() for c in b.columns] for b in batches for i in range(b.num_rows))

    schema = ", ".join(f"{n} array<double>" for n in names)
    rows = df.mapInArrow(first, schema).repartition(width).mapInArrow(again, schema).repartition(1).mapInArrow(again, schema).toArrow()
    total = [rows.column(n).combine_chunks().flatten().to_numpy() for n in names] if rows.num_rows else None
    if total is None:
        raise ValueError("no vectors to fit on")
    return dict(zip(names, total, strict=True))
