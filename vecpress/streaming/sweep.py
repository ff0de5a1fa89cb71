"""Streaming encode-and-score: rows arrive in files, are encoded and decoded by a fitted codec
in the plan, and one running aggregate holds rows and squared error. `TrainedStream` learns its
codec from the stream itself, and keeps what it encodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.functions import distance
from vecpress.functions.arrays import vectors
from vecpress.operators.codecs import Codec
from vecpress.sources import models


def stream_vectors(spark: SparkSession, folder: str, files_per_batch: int = 1, pattern: str | None = None) -> DataFrame:
    """(vec_id, v) of Parquet files as they appear in a folder."""
    schema = spark.read.parquet(f"{folder}/{pattern}" if pattern else folder).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return vectors(reader.parquet(folder))


def train_on_first(codec: Codec, x: DataFrame, rows: int) -> Codec:
    """The codec, fitted on the rows with the `rows` smallest ids: what a stream has to go by
    before the rest of it is there."""
    return codec.fit(x.orderBy("vec_id").limit(rows))


def streaming_distortion(stream: DataFrame, codec: Codec, checkpoint: str, name: str = "distortion", max_batches: int | None = None) -> DataFrame:
    """Mean squared error of a row over all the stream has, as (distortion, n).

    max_batches stops the stream after so many micro-batches; what they held is the result.
    """
    spark = stream.sparkSession
    pairs = codec.reconstruct(stream)
    error = pairs.select(distance.squared_l2(F.col("v"), F.col("r")).alias("e"))
    if max_batches is None:
        sums = error.agg(F.sum("e").alias("e"), F.count("*").alias("n"))
        query = sums.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        query.awaitTermination()
        total = spark.table(name)
    else:
        seen: list[tuple[float, int]] = []

        def batch(rows: DataFrame, number: int) -> None:
            if number < max_batches:
                e, n = rows.agg(F.coalesce(F.sum("e"), F.lit(0.0)), F.count("*")).head()
                seen.append((e, n))

        query = error.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        while not query.awaitTermination(1) and len(seen) < max_batches:
            pass
        query.stop()
        total = spark.createDataFrame(seen, "e double, n long").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    return total.select((F.col("e") / F.col("n")).alias("distortion"), F.col("n"))


class TrainedStream:
    """A stream that trains its codec on its first rows and is encoded from then on.

    All of it lives in `folder`, which all executors share. Batches go to first/batch=N until they
    hold `rows` rows; of these the `rows` with the smallest ids fit the codec, once, and it is
    stored. Then the batches that waited are encoded, and each later one as it comes, to
    codes/batch=N, with its rows and squared error in sums/batch=N. Each batch is written whole
    under its own number and counts when its sums are there, so a batch that runs again after a
    restart replaces itself, and totals are read from the folder and not from memory. A stream that
    ends before it has `rows` rows is fitted on those it has by `finish`.
    """

    def __init__(self, spark: SparkSession, folder: str, codec: Codec, rows: int):
        if rows < 1:
            raise ValueError("a codec is fitted on one row at least")
        self.spark, self.folder, self.codec, self.rows = spark, folder.rstrip("/"), codec, rows

    def _path(self, *parts: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _done(self, *parts: str) -> bool:
        system, target = self._path(*parts, "_SUCCESS")
        return system.exists(target)

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the batches that are whole."""
        system, target = self._path(kind)
        if not system.exists(target):
            return []
        names = [s.getPath().getName() for s in system.listStatus(target)]
        return sorted(n for n in (int(name[6:]) for name in names if name.startswith("batch=")) if self._done(kind, f"batch={n}"))

    def _first(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, v array<double>").parquet(*[f"{self.folder}/first/batch={n}" for n in self._batches("first")])

    def fitted(self) -> Codec | None:
        """The stored codec, if there is one yet."""
        return models.load_codec(self.spark, f"{self.folder}/codec") if self._done("codec", "model") else None

    def _fit(self) -> Codec:
        codec = self.codec.fit(self._first().orderBy("vec_id").limit(self.rows))
        models.save_codec(self.spark, codec, f"{self.folder}/codec")
        return codec

    def _encode(self, codec: Codec, x: DataFrame, number: int) -> None:
        codec.encode(x).write.mode("overwrite").parquet(f"{self.folder}/codes/batch={number}")
        error = codec.reconstruct(x).select(distance.squared_l2(F.col("v"), F.col("r")).alias("e"))
        sums = error.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"), F.count("*").alias("n"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")

    def _waiting(self, codec: Codec) -> None:
        """Encodes what came before the codec."""
        done = set(self._batches("sums"))
        for n in self._batches("first"):
            if n not in done:
                self._encode(codec, self.spark.read.schema("vec_id long, v array<double>").parquet(f"{self.folder}/first/batch={n}"), n)

    def batch(self, x: DataFrame, number: int) -> None:
        """One micro-batch (vec_id, v)."""
        codec = self.fitted()
        if codec is None:
            x.write.mode("overwrite").parquet(f"{self.folder}/first/batch={number}")
            if self._first().count() < self.rows:
                return
            codec = self._fit()
        self._waiting(codec)
        if number not in self._batches("first"):
            self._encode(codec, x, number)

    def run(self, stream: DataFrame, checkpoint: str, max_batches: int | None = None) -> None:
        """Takes what the stream has now; max_batches: batches of higher numbers are left out."""

        def batch(x: DataFrame, number: int) -> None:
            if max_batches is None or number < max_batches:
                self.batch(x, number)

        query = stream.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        query.awaitTermination()

    def finish(self) -> None:
        """Fits on fewer rows, if the stream ended before it had enough, and encodes what waits."""
        if self._batches("first"):
            self._waiting(self.fitted() or self._fit())

    def codes(self) -> DataFrame:
        """(vec_id, code) of all whole batches."""
        done = [f"{self.folder}/codes/batch={n}" for n in self._batches("sums")]
        return self.spark.read.schema("vec_id long, code binary").parquet(*done) if done else self.spark.createDataFrame([], "vec_id long, code binary")

    def distortion(self) -> DataFrame:
        """(distortion, n): mean squared error of a row over all whole batches."""
        done = [f"{self.folder}/sums/batch={n}" for n in self._batches("sums")]
        sums = self.spark.read.schema("e double, n long").parquet(*done) if done else self.spark.createDataFrame([], "e double, n long")
        return sums.agg(F.sum("e").alias("e"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select((F.col("e") / F.col("n")).alias("distortion") if done else F.lit(None).cast("double").alias("distortion"), "n")
