"""Shared plumbing: where tables are written between steps, and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is at most this large, by measure: rows, and bytes of what they hold.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20

_own_dir: str | None = None


class _Written(threading.local):
    """Folders of the tables that this thread has written and not deleted."""

    def __init__(self):
        self.paths: set[str] = set()


_written = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master
    gets a folder of its own; a cluster has none that is shared, and an error says so."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="vecpress-checkpoint-")
    return _own_dir


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    This cuts lineage: a lost executor costs the running tasks, not the steps before. The
    folder goes when the application ends, or before that by `forget` or `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecpress/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = _folder(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _written.paths.add(path)
    out._vecpress_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _written.paths.discard(path)
    system, target = _folder(spark, path)
    system.delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._vecpress_path)


def written() -> set[str]:
    """The folders that this thread has written so far, as a mark for `release`."""
    return set(_written.paths)


def release(spark: SparkSession, since: set[str], keep: DataFrame) -> None:
    """Deletes what this thread has written after the mark `since`, save the table `keep`."""
    for path in _written.paths - since - {keep._vecpress_path}:
        _delete(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is within both limits: its rows and bytes are summed first,
    strings by their length, other columns by eight bytes.

    Beyond them the join shuffles both sides and adaptive execution splits hot keys.
    """
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    total = sum(width[1:], width[0]).cast("long")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).head()
    return F.broadcast(df) if n <= rows and held <= size else df


def shuffled(df: DataFrame) -> DataFrame:
    """df, marked for a sort-merge join whatever its size: for sides that grow with the input, so
    that the plan is the same at every size and adaptive execution can split hot keys."""
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col):
    """A-Z lower-cased, every other character kept (lower() would fold more)."""
    return F.translate(col, _UPPER, _UPPER.lower())


def give_back() -> None:
    """Returns memory that this worker has freed to the system: workers wait for their next task
    beside others, and the C library keeps what they no longer use. Without it, nothing happens."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


class _Generation(dict):
    """A dictionary that fills itself: a missing value comes from the generation before, or is learned."""

    def __init__(self, old: dict, learn: Callable):
        super().__init__()
        self.old, self.learn = old, learn

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        self[key] = value
        return value


class Recent:
    """What a worker remembers of words or chunks of text, in bounded memory.

    Two generations of about `most` entries: when the new one is full it becomes the old one,
    and entries that are asked for again move on from there. So frequent ones stay.
    """

    def __init__(self, most: int, learn: Callable):
        self.most = most
        self.new = _Generation({}, learn)

    def lookup(self) -> Callable:
        """From keys to values, for one batch of texts."""
        if len(self.new) > self.most:
            self.new.old = {}
            self.new = _Generation(self.new, self.new.learn)
        return self.new.__getitem__

    def rest(self, keep: int = 0) -> None:
        """Forgets: a worker that waits for its next task keeps the `keep` entries that came first,
        which are mostly frequent ones."""
        first = dict(islice(self.new.items(), keep))
        self.new = _Generation({}, self.new.learn)
        self.new.update(first)
