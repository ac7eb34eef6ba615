"""Follow mode: new lines, ordered within each batch.

Two sources: ``growing_lines`` follows files that grow, are renamed or replaced
(``sources.growing``); ``follow_source`` follows a landing folder with Spark's
file source, which reads a file once, when it appears, so that files are to be
moved into the folder whole.

Two ways to batches: ``follow_batches`` keeps lines in the state store until
there are enough or the time is over (``streaming.batches``); ``follow_merged``
takes each micro-batch, in the order of arrival (a file's time, its path, the
place in it), in batches of at most ``most_lines``, each ordered by itself. Lines
that come late stay in the batch in which they arrive.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import decode
from ..functions.derive import base_name
from ..operators import order
from ..operators.profile import shape_counts
from ..plans.landing import forget


def follow_source(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (file, line, block_start, arrival)."""
    reader = spark.readStream.option("lineSep", "\n").option("latestFirst", "false")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    meta = F.col("_metadata")
    return reader.text(folder).select(meta["file_path"].alias("file"), decode.strip_line_ending(F.col("value")).alias("line"), meta["file_block_start"].alias("block_start"), meta["file_modification_time"].alias("arrival"))


def growing_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of (file, line, start_byte, bytes, arrival, generation) of files that grow; options as in ``sources.growing``.

    A micro-batch is dealt to all cores, unless ``minPartitions`` says otherwise.
    """
    from ..sources.growing import NAME, GrowingLines

    spark.dataSource.register(GrowingLines)
    options = {"minPartitions": 2 * spark.sparkContext.defaultParallelism} | options
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(folder)


def follow_lines(spark: SparkSession, folder: str, existing: list[str], files_per_trigger: int | None = None) -> DataFrame:
    """Only lines of files that weren't there at the start."""
    stream = follow_source(spark, folder, files_per_trigger)
    if not existing:
        return stream
    there = spark.createDataFrame([(p,) for p in existing], "file string")
    return stream.join(there, "file", "left_anti")


def follow_from(spark: SparkSession, folder: str, existing: list[str], n: int, source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(last n lines of each existing source, the stream of new lines).

    A source is a file, unless ``source``, a column of ``file``, takes several as one.
    """
    from ..operators.slices import last_lines
    from ..sources.lines import read_lines

    lines = read_lines(spark, existing).withColumn("source", F.col("file") if source is None else source)
    return last_lines(lines, n, "source"), follow_lines(spark, folder, existing)


def follow_batches(lines: DataFrame, sink: str, checkpoint: str, by: Column | None = None, headers: str = "swap", window_ms: int = 250, most_lines: int = 1000, name: Column | None = None) -> StreamingQuery:
    """Decode growing lines and append them to a Parquet folder in batches of ``window_ms`` or ``most_lines``, whichever is first.

    Batch numbers, positions and the last header are kept in the state store, per
    value of ``by``; a restart from the checkpoint goes on with them, and with the
    lines that were held. A key's task sorts its share of a micro-batch, so where
    much may be waiting, bound micro-batches by the source's ``maxBytesPerTrigger``.
    """
    from .batches import arriving_batches

    parsed = decode.unified_record(decode.classified(lines.withColumn("name", base_name(F.col("file")) if name is None else name)))
    out = arriving_batches(decode.dropped(parsed), by, most_lines, window_ms, headers)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{window_ms} milliseconds").start()


def wait_for(spark: SparkSession, query: StreamingQuery, sink: str, rows: int, seconds: int = 600) -> None:
    """Until a sink holds so many rows; an error if the query ends, or if no row comes for so many seconds."""
    came, there = time.monotonic(), 0
    while True:
        try:
            before, there = there, spark.read.parquet(sink).count()
            if there >= rows:
                return
            if there > before:
                came = time.monotonic()
        except AnalysisException:  # nothing is there yet
            if not rows:
                return
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() - came > seconds:
            raise TimeoutError(f"{there} of {rows} rows, and no more for {seconds} seconds")
        time.sleep(0.5)


def ordered_batch(batch: DataFrame, batch_id: int, last_name: str | None = None, headers: str = "swap", most_lines: int = 1000, name: Column | None = None) -> DataFrame:
    """Rows of one micro-batch in order: batch_id, sub_no, pos, header, file, ts, level, message, line, shape.

    Nothing is sorted by ranges, whose samples of keys would go to the driver and
    would decode each line twice. A line's place of arrival is its place in its
    block of a file, after the lines of the blocks before (a count each). All
    sub-batches but the last are full, so a line's position follows from its
    sub-batch and its place in it, and lines are decoded where these are ordered.
    """
    spark, block = batch.sparkSession, ["arrival", "file", "block_start"]
    came = order.written(batch.withColumn("__no", F.monotonically_increasing_id()), "arrived")
    before = W.orderBy("arrival", F.split("file", "/"), "block_start").rowsBetween(W.unboundedPreceding, -1)
    starts = came.groupBy(*block).agg(F.count(F.lit(1)).alias("__n")).select(*block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row for each block
    place = F.row_number().over(W.partitionBy(*block).orderBy("__no"))
    arrived = came.join(F.broadcast(starts), block).withColumn("seq", (F.col("__start") + place - 1).cast("long")).drop("__no", "__start")
    arrived = arrived.withColumn("sub_no", F.floor(F.col("seq") / most_lines).cast("long")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sub_no")
    parsed = decode.dropped(decode.unified_record(decode.classified(arrived)))
    within = F.row_number().over(W.partitionBy("sub_no").orderBy(F.col("ts").asc_nulls_last(), F.coalesce("ts_nanos", F.lit(0)), "seq"))
    placed = order.written(parsed.withColumn("pos", (F.col("sub_no") * most_lines + within - 1).cast("long")), "placed")
    placed = order.source_headers(placed, headers, last_name, name=name)
    return placed.select(F.lit(batch_id).cast("long").alias("batch_id"), "sub_no", "pos", "header", "file", "ts", "level", "message", "line", "shape")


def _last_name(spark: SparkSession, path: str) -> str | None:
    """The name that a batch left; none where there is no such batch, or it is gone."""
    try:
        return spark.read.schema("name string").parquet(path).first()["name"]
    except (AnalysisException, TypeError):
        return None


def follow_merged(stream: DataFrame, sink: str, checkpoint: str, headers: str = "swap", interval: str | None = "250 milliseconds", then: Callable[[DataFrame, int], None] | None = None, most_lines: int = 1000, name: Column | None = None) -> StreamingQuery:
    """Append each micro-batch, ordered, to a Parquet folder (one sub-folder a batch, so a repeat replaces it).

    The last header carries over: each batch leaves its last name beside the
    checkpoint (``<checkpoint>-headers``, one row), and a batch without rows
    passes on the one before.
    """
    shown = base_name(F.col("file")) if name is None else name

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, kept = batch.sparkSession, f"{checkpoint}-headers"
        last = _last_name(spark, f"{kept}/{batch_id - 1}")
        with order.scratch_of_a_while(spark):
            ordered_batch(batch, batch_id, last, headers, most_lines, name).drop("batch_id").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        out = spark.read.parquet(f"{sink}/batch_id={batch_id}")
        row = out.orderBy(F.desc("pos")).select(shown.alias("name")).first()
        spark.createDataFrame([(row["name"] if row else last,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{kept}/{batch_id}")
        forget(spark, f"{kept}/{batch_id - 2}")  # a batch is repeated at most from the one before
        if then is not None:
            then(out, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def follow_profile(stream: DataFrame, sink: str, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
    """Count the shapes of lines while they come: each micro-batch appends the totals that it has changed.

    The totals are in the state store, so a restart goes on with them; a repeated
    batch replaces its own rows.
    """
    counts = shape_counts(decode.classified(stream))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def profile_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The latest total of each shape."""
    return spark.read.schema("shape string, n long, batch_id long").parquet(sink).groupBy("shape").agg(F.max_by("n", "batch_id").alias("n"))
