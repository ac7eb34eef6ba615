"""Helpers that the operators of this subpackage share.

Everything that has to survive a lost executor is written as Parquet (or as
files) below the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of this name below the shared folder of the session.

    The session's ``spark.checkpoint.dir`` decides. Where that is unset, a local
    folder is used by a local session (as in tests); on a cluster it is an error,
    since executors don't share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loglathe-scratch")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``scratch`` named and nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str, until: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    ``until`` gets the path, for ``forget`` when the table has been used.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if until is not None:
        until.append(path)
    return spark.read.schema(df.schema).parquet(path)


SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind (else they stay until the driver collects garbage).

    Spark before 4.1 doesn't know the setting and keeps them.
    """
    before = spark.conf.get(SHUFFLES_DROPPED, None)
    spark.conf.set(SHUFFLES_DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_DROPPED) if before is None else spark.conf.set(SHUFFLES_DROPPED, before)


#: Bytes of a side that may be broadcast, where its size in bytes is known.
MOST_BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, most_rows: int, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint only if its counted rows (and its bytes, if given) are within a bound.

    Beyond the bound the join shuffles both sides and adaptive execution splits
    skewed partitions, so no broadcast ever grows with the corpus.
    """
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= MOST_BROADCAST_BYTES else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession | None = None) -> None:
    """Arrow batches of at most 4 MB, unless the application was started with a size of its own.

    Texts may be long, and a worker holds several copies of the batch it is at.
    """
    spark = spark or SparkSession.active()
    if spark.sparkContext.getConf().get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, "4m")


def local_path(uri: str):
    """(pyarrow file system, path) of a folder, for tasks that write real files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Memo(dict):
    """A dict that computes what it lacks, of at most ``most`` entries.

    When half of them are used, they become the older half, and the half before
    is forgotten; what is asked for again moves back. Keys of over ``longest``
    characters (numbers: None) are computed but not kept, so its bytes are
    bounded too.
    """

    def __init__(self, compute, most: int = 100_000, longest: int | None = 64):
        super().__init__()
        self.compute, self.half, self.longest, self.older = compute, most // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
