"""Lines of text files with their source, number and byte offset; sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.decode import strip_line_ending


def file_statuses(spark: SparkSession, patterns: list[str]) -> list:
    """Hadoop's status of each file that the patterns match, by path; escaped wildcards count as wildcards; an error if there is none."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(re.sub(r"\\([*?\[\]{}])", r"\1", pattern))
        for status in path.getFileSystem(conf).globStatus(path) or []:
            if status.isFile():
                found[status.getPath().toString()] = status
    if not found:
        raise FileNotFoundError(f"no file matches {patterns}")
    return [found[name] for name in sorted(found)]


def expand_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that the patterns match, sorted; escaped wildcards count as wildcards; an error if there is none."""
    return [status.getPath().toString() for status in file_statuses(spark, patterns)]


def read_lines(spark: SparkSession, paths: str | list[str], raw: bool = False) -> DataFrame:
    """One row for each line: file, line, and where the block and the file stand.

    Only a line feed ends a line; one carriage return before it is dropped
    unless ``raw``.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    meta = F.col("_metadata")
    line = F.col("value") if raw else strip_line_ending(F.col("value"))
    return text.select(meta["file_path"].alias("file"), line.alias("line"), F.octet_length("value").cast("long").alias("bytes"), meta["file_block_start"].alias("block_start"), meta["file_size"].alias("file_size"))


def read_sources(spark: SparkSession, patterns: list[str], raw: bool = False) -> DataFrame:
    return read_lines(spark, expand_paths(spark, patterns), raw)


def spread(lines: DataFrame, *by: str, task_bytes: int = 1 << 20) -> DataFrame:
    """Deal lines just read over tasks by a hash of the columns ``by``: as many rounds of tasks on all cores as bring a task to ``task_bytes`` of what is read.

    Decoding takes far longer than reading, and a Parquet file has as many tasks
    with rows as row groups, whatever its splits; so the size of a task is set
    here and does not grow with the input.
    """
    read = sum(_size(lines.sparkSession, name) for name in lines.inputFiles())
    cores = lines.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, -(-min(read // task_bytes, MOST_TASKS) // cores))  # whole rounds of all cores
    return lines.repartition(rounds * cores, *by)


#: Beyond it tasks grow again: a shuffle's bookkeeping grows with the square of their number.
MOST_TASKS = 5000


def _size(spark: SparkSession, name: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()


def block_starts(lines: DataFrame, amount: Column, by: str = "file") -> DataFrame:
    """One row for each block of a file: file, block_start, the totals of the source's blocks before it and after it.

    A source is a file, or all files of one value of ``by`` in the order of
    their names.
    """
    totals = lines.groupBy(*dict.fromkeys([by, "file", "block_start"])).agg(F.sum(amount).alias("__total"))
    order = W.partitionBy(by).orderBy("file", "block_start")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    return totals.select("file", "block_start", *[F.coalesce(F.sum("__total").over(w), F.lit(0)).alias(n) for w, n in ((before, "__start"), (after, "__after"))])


def placed(lines: DataFrame, starts: DataFrame, name: str, within: Column) -> DataFrame:
    """Add a running total over each source: within a block, plus the totals of the blocks before.

    A block is one task's share of a file, so no task sorts a whole file, and the
    joined side has one row for each block.
    """
    block = W.partitionBy("file", "block_start").orderBy("__at")
    joined = lines.withColumn("__at", F.monotonically_increasing_id()).join(starts, ["file", "block_start"])
    return joined.withColumn(name, (F.col("__start") + within.over(block)).cast("long")).drop("__at", "__start", "__after")


def with_line_numbers(lines: DataFrame, by: str = "file") -> DataFrame:
    """Add line_no, from 0 in each source."""
    return placed(lines, block_starts(lines, F.lit(1), by), "line_no", F.row_number()).withColumn("line_no", F.col("line_no") - 1)


def with_byte_offsets(lines: DataFrame, by: str = "file") -> DataFrame:
    """Add start_byte of each line in its source; file_size becomes the source's."""
    size = F.col("bytes") + 1
    out = placed(lines, block_starts(lines, size, by), "end_byte", F.sum(size)).withColumn("start_byte", F.col("end_byte") - F.col("bytes") - 1).drop("end_byte")
    if by == "file":
        return out
    whole = lines.groupBy(by, "file").agg(F.max("file_size").alias("__size")).groupBy(by).agg(F.sum("__size").alias("__size"))
    return out.join(whole, by).withColumn("file_size", F.col("__size")).drop("__size")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def write_rendered(ordered: DataFrame, path: str, rendered_col: str = "rendered", text_shape_col: str | None = None) -> None:
    """Write rendered rows in their order; a record is followed by a blank line, a text line isn't."""
    value = F.col(rendered_col)
    if text_shape_col is not None:
        value = F.when(F.col(text_shape_col) == "text", value).otherwise(F.concat(value, F.lit("\n")))
    ordered.select(value.alias("value")).write.text(path, lineSep="\n")


def write_records(records: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append records (with shape and ts) to a Parquet folder by shape and date, each file in the order of time.

    Rows are dealt by ranges of (date, shape, time), so a file holds a stretch of
    time of its own, however many rows a day has, and statistics of files and row
    groups prune reads by time; rows without a time are a partition of their own.
    The ranges are cut by a sample, which would compute every record a second
    time, so the records are written to a table of a while before they are dealt.
    """
    from ..operators.order import scratch_of_a_while, written

    with scratch_of_a_while(records.sparkSession):
        dated = written(records.withColumn("date", F.col("ts").cast("date")), "to-deal")
        dealt = dated.repartitionByRange("date", "shape", "ts").sortWithinPartitions("shape", "date", "ts")
        dealt.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("shape", "date").parquet(path)


def read_records(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None, shapes: list[str] | None = None) -> DataFrame:
    """Records from a time on, before another, of some shapes; only the partitions and row groups that may hold them are read."""
    out = spark.read.parquet(path)
    if shapes:
        out = out.where(F.col("shape").isin(shapes))
    for limit, late in ((begin, False), (end, True)):
        if limit is not None:
            time = F.lit(limit).cast("timestamp")
            out = out.where((F.col("date") <= time.cast("date")) & (F.col("ts") < time) if late else (F.col("date") >= time.cast("date")) & (F.col("ts") >= time))
    return out


def apply_lines(lines: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a function of pandas batches to the lines."""
    return lines.mapInPandas(fn, schema)
