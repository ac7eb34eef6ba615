"""Text files made from the ``events`` table, below the session's shared folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import blocks
from ..sources.lines import read_lines
from . import synth


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a local one for a local session (as in tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loglathe-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def source_of(file: Column) -> Column:
    return F.regexp_extract(file, r"source=([^/]+)", 1)


def write_sources(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each source with its lines in the order of events, cut into files by ranges of events.

    A source's files are in the order of their names, so no source, however
    large, is one task's.
    """
    folder = scratch(spark, "landed")
    ev = synth.events(spark, sf_dir)
    lines = ev.select("event_id", F.concat("m", F.lit(" plain")).alias("value"), F.element_at(F.split("file", "/"), -1).alias("source"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "source", "event_id").sortWithinPartitions("source", "event_id")
    dealt.drop("event_id").write.partitionBy("source").text(folder, lineSep="\n")
    return folder


_LANDED: dict[tuple[str, str], str] = {}


def landed_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of ``write_sources``, written once an application for each data set."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _LANDED:
        _LANDED[key] = write_sources(spark, sf_dir)
    return _LANDED[key]


def landed(spark: SparkSession, sf_dir: str, raw: bool = True) -> DataFrame:
    """Lines of the landed text files, with their source's name."""
    return read_lines(spark, f"{landed_folder(spark, sf_dir)}/*", raw).withColumn("source", source_of(F.col("file")))


def landed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block index of the landed files, stored beside them."""
    folder = landed_folder(spark, sf_dir)
    return blocks.index(spark, [f"{folder}/*/*.txt"], f"{folder}-index")


def append_portion(lines: DataFrame, folder: str, finished: bool) -> int:
    """Append (app, event_id, value) to the files ``app-<app>.log`` of a folder, in the order of events, and count the lines.

    A line feed comes before each line but a file's first one, so the last line
    stays unfinished; ``finished`` adds the line feed. Lines are made and sorted by
    all tasks, in files by ranges of events; what one task does for an app is to
    append the bytes of these files, a few MB at a time.
    """
    spark = lines.sparkSession
    parts = scratch(spark, "portion")
    dealt = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "app", "event_id").sortWithinPartitions("app", "event_id")
    dealt.select("app", "value").write.partitionBy("app").text(parts, lineSep="\n")

    def add(batches):
        (store, top), (_, source) = fs.FileSystem.from_uri(folder), fs.FileSystem.from_uri(parts)
        store.create_dir(top)
        for batch in batches:
            for app in batch.column(0).to_pylist():
                files = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{source}/app={app}")) if i.base_name.startswith("part-"))
                path, n = f"{top}/app-{app}.log", 0
                held = b"\n" if store.get_file_info(path).type == fs.FileType.File else b""
                with store.open_append_stream(path) as out:
                    for file in files:
                        with store.open_input_stream(file) as part:
                            while data := part.read(8 << 20):
                                n += data.count(b"\n")
                                out.write(held + data[:-1])
                                held = data[-1:]  # the last line feed of all is left out
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    store, source = fs.FileSystem.from_uri(parts)
    apps = [i.base_name.removeprefix("app=") for i in store.get_file_info(fs.FileSelector(source)) if i.base_name.startswith("app=")]
    total = 0
    if apps:
        total = spark.createDataFrame(pa.table({"app": apps})).repartition(len(apps), "app").mapInArrow(add, "n long").agg(F.sum("n")).first()[0]
    forget(spark, parts)
    if finished:
        store, top = fs.FileSystem.from_uri(folder)
        for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            with store.open_append_stream(info.path) as out:
                out.write(b"\n")
    return total


def land_portion(lines: DataFrame | None, spark: SparkSession, folder: str) -> None:
    """Files of (app, event_id, value) by app, all of one time, so that they arrive in the order of their names; None is one file without lines."""
    if lines is None:
        spark.createDataFrame([], "value string").coalesce(1).write.text(f"{folder}/app=0")
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = lines.repartitionByRange(n, "app", "event_id").sortWithinPartitions("app", "event_id")
        dealt.select("app", "value").write.partitionBy("app").text(folder, lineSep="\n")
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    now = int(time.time() * 1000)
    for status in fs.globStatus(top) or []:  # at most two files for each partition
        fs.setTimes(status.getPath(), now, -1)
