"""Saved codecs and inverted files: arrays as Parquet rows, the rest as JSON text. No pickles.

A folder holds `model` (name, position, shape, values; scalars under `json`) and, for an
inverted file, `codes` partitioned by cell, so that a search reads only the cells it probes.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.operators import codecs
from vecpress.operators.ivf import IVF
from vecpress.sources import fvecs

SCHEMA = "name string, position int, shape array<int>, values array<double>, json string"

CODECS = {c.name: c for c in (codecs.Scalar, codecs.Product, codecs.OptimizedProduct, codecs.SignBit, codecs.MultiBit, codecs.Local, codecs.RankAware, codecs.Segmented)}


def to_rows(state: dict, prefix: str = "") -> list[tuple]:
    rows = []
    for name, value in state.items():
        if isinstance(value, codecs.Codec):
            rows.append((f"{prefix}{name}", None, None, None, json.dumps({"codec": value.name})))
            rows += to_rows(value.__dict__, f"{prefix}{name}/")
        elif isinstance(value, dict):  # a codec for each cell
            kind = next(iter(value.values())).name if value else None
            rows.append((f"{prefix}{name}", None, None, None, json.dumps({"cells": sorted(map(int, value)), "codec_of_cells": kind})))
            for cell, codec in value.items():
                rows += to_rows(codec.__dict__, f"{prefix}{name}/{int(cell)}/")
        elif isinstance(value, np.ndarray):
            rows.append((f"{prefix}{name}", -1, list(value.shape), value.astype(float).ravel().tolist(), json.dumps(str(value.dtype))))
        elif isinstance(value, list) and value and isinstance(value[0], np.ndarray):
            rows += [(f"{prefix}{name}", i, list(v.shape), v.astype(float).ravel().tolist(), json.dumps(str(v.dtype))) for i, v in enumerate(value)]
        else:
            plain = value.item() if isinstance(value, np.generic) else value
            rows.append((f"{prefix}{name}", None, None, None, json.dumps({"value": plain})))
    return rows


def from_rows(rows: list, prefix: str = "") -> dict:
    state: dict = {}
    for r in sorted((r for r in rows if r["name"].startswith(prefix)), key=lambda r: (r["name"], r["position"] or 0)):
        name = r["name"][len(prefix) :]
        if "/" in name:
            continue
        told = json.loads(r["json"])
        if r["shape"] is not None:
            value = np.array(r["values"]).reshape(r["shape"]).astype(told)
            if r["position"] >= 0:
                state.setdefault(name, []).append(value)
            else:
                state[name] = value
        elif "cells" in told:
            state[name] = {c: _codec(told["codec_of_cells"], from_rows(rows, f"{prefix}{name}/{c}/")) for c in told["cells"]}
        elif "codec" in told:
            state[name] = _codec(told["codec"], from_rows(rows, f"{prefix}{name}/"))
        else:
            value = told["value"]
            state[name] = [tuple(v) for v in value] if name == "plan" else value
    return state


def _codec(name: str, state: dict) -> codecs.Codec:
    out = CODECS[name].__new__(CODECS[name])
    out.__dict__.update(state)
    return out


def save_codec(spark: SparkSession, codec: codecs.Codec, path: str) -> None:
    spark.createDataFrame(to_rows({"codec": codec}), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_codec(spark: SparkSession, path: str) -> codecs.Codec:
    return from_rows(spark.read.schema(SCHEMA).parquet(f"{path}/model").collect())["codec"]


def save_index(index: IVF, codes: DataFrame, path: str) -> None:
    """The model, and its codes dealt by cell; large cells are split among files."""
    spark = codes.sparkSession
    spark.createDataFrame(to_rows(index.__getstate__()), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    dealt = codes.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")


def load_index(spark: SparkSession, path: str) -> tuple[IVF, DataFrame]:
    index = IVF._from(from_rows(spark.read.schema(SCHEMA).parquet(f"{path}/model").collect()))
    codes = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/codes")
    return index, codes.select("cell", "vec_id", "code")


def codebook(codec: codecs.Codec) -> np.ndarray:
    """Rows of a codec's codebook: sub-space by sub-space, or the ends of the ranges."""
    if isinstance(codec, codecs.Product):
        return codec.books.reshape(-1, codec.books.shape[2])
    if isinstance(codec, codecs.Scalar):
        return np.stack([codec.low, codec.high])
    raise RuntimeError(f"{codec.name} has no codebook of vectors")


def export_codebook(spark: SparkSession, codec: codecs.Codec, path: str, codes: DataFrame | None = None) -> None:
    """The codebook as path.fvecs and, with codes (vec_id, code), their bytes as path.codes.ivecs."""
    fvecs.write_bytes(spark, f"{path}.fvecs", [fvecs.dump(codebook(codec))])
    if codes is not None:
        rows = codes.select("vec_id", F.transform(F.sequence(F.lit(1), F.octet_length("code")), lambda i: F.conv(F.hex(F.substring("code", i, F.lit(1))), 16, 10).cast("double")).alias("embedding"))
        fvecs.write(rows, f"{path}.codes.ivecs", kind="i")


def write_csv(results: DataFrame, path: str) -> None:
    """One file of a small result table, with a header."""
    lines = [",".join(results.columns)] + [",".join("" if v is None else str(v) for v in r) for r in results.collect()]
    fvecs.write_bytes(results.sparkSession, path, [("\n".join(lines) + "\n").encode()])
