"""Chronological merge, source headers and arrival batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.derive import base_name
from ..plans.landing import forget, scratch

KEYS = ["ts", "ts_nanos", "__file_parts", "line_no"]


_WHILE: ContextVar[list[str] | None] = ContextVar("paths of tables that go at the end", default=None)


@contextmanager
def scratch_of_a_while(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` within are deleted at its end: their results have been stored by then."""
    token = _WHILE.set([])
    try:
        yield
    finally:
        forget(spark, *_WHILE.get())
        _WHILE.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows doesn't compute it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    if _WHILE.get() is not None:
        _WHILE.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def merge_chronological(lines: DataFrame) -> DataFrame:
    """Order by time (rows without one last), then file by path parts, then line number.

    One range shuffle; file and line number are in the key, so rows without a
    time, or with one hot second, are still dealt over all partitions. The lines
    are written before it: the shuffle samples its input, which would decode
    every line a second time.
    """
    keyed = written(lines, "to-merge").withColumn("__file_parts", F.split("file", "/"))
    return keyed.orderBy(F.col("ts").asc_nulls_last(), F.coalesce("ts_nanos", F.lit(0)), "__file_parts", "line_no").drop("__file_parts")


def merge_sorted(lines: DataFrame, name: str = "pos") -> DataFrame:
    """Number the lines in the order of ``merge_chronological``, without a shuffle of what is in order already.

    Each partition is sorted by itself and written as two runs, lines with a time
    and lines without. A run that meets no other (by its first and last key) keeps
    its lines where they are: its numbers are the lines of all runs before it, and
    the place in it. Only runs that overlap are dealt by ranges. So of sources that
    follow each other in time, as rotated files do, only the edges are shuffled;
    of sources that all run at once, everything is. The result has positions, and
    is in order where it is read by them.
    """
    key = F.struct(F.col("ts").isNull().alias("late"), "ts", F.coalesce("ts_nanos", F.lit(0)).alias("nanos"), F.split("file", "/").alias("parts"), "line_no")
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = lines.withColumn("__key", key).sortWithinPartitions("__key").withColumns({"__part": F.spark_partition_id(), "__own": own, "__late": F.col("ts").isNull()})
    runs = written(sorted_, "runs")
    bounds = runs.groupBy("__part", "__late").agg(F.min("__key").alias("low"), F.max("__key").alias("high"), F.count(F.lit(1)).alias("n"), F.min("__own").alias("__first"))
    # a few rows for each partition: runs in order, and islands of runs that overlap
    in_order = W.orderBy("low", "high", "__part")
    bounds = bounds.withColumn("__new", F.coalesce(F.max("high").over(in_order.rowsBetween(W.unboundedPreceding, -1)) < F.col("low"), F.lit(True)))
    bounds = bounds.withColumn("__island", F.sum(F.col("__new").cast("int")).over(in_order))
    islands = bounds.groupBy("__island").agg(F.sum("n").alias("__size"), F.count(F.lit(1)).alias("__runs"))
    before = W.orderBy("__island").rowsBetween(W.unboundedPreceding, -1)
    alone = F.when(F.col("__runs") == 1, F.col("__size")).otherwise(0)
    islands = islands.withColumns({"__start": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__alone_before": F.coalesce(F.sum(alone).over(before), F.lit(0))})
    places = written(bounds.select("__part", "__late", "__first", "__island").join(islands.drop("__size"), "__island"), "islands")
    placed = runs.join(F.broadcast(places), ["__part", "__late"])
    kept = placed.where("__runs = 1").withColumn(name, (F.col("__start") + F.col("__own") - F.col("__first")).cast("long"))
    meeting = placed.where("__runs > 1").select(*lines.columns, "__key", "__alone_before")
    mixed = with_position(meeting.orderBy("__key"), "__at").withColumn(name, (F.col("__at") + F.col("__alone_before")).cast("long"))
    return kept.select(*lines.columns, name).unionByName(mixed.select(*lines.columns, name))


def with_position(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of an ordered frame from 0, without a window over all rows.

    Rows are numbered within their partition; the partitions' sizes (one row
    each) are summed up and added. The frame is written once with both numbers:
    evaluated twice, a range shuffle may cut its partitions elsewhere.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = written(ordered.withColumns({"__part": F.spark_partition_id(), "__own": own}), "ordered")
    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row for each partition
    return tagged.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__part", "__own", "__start")


def source_headers(positioned: DataFrame, mode: str = "swap", last_name: str | None = None, pos: str = "pos", name: Column | None = None) -> DataFrame:
    """Add ``header`` (``==> name <==`` or null) to rows that carry a dense position; the name is the file's base name.

    ``swap``: where the base name differs from the row before; ``every``;
    ``never``. The row before comes by windows of 100,000 positions, and for the
    first row of a window from its neighbour window's last row.
    """
    name = base_name(F.col("file")) if name is None else name
    text = F.concat(F.lit("==> "), name, F.lit(" <=="))
    if mode == "never":
        return positioned.withColumn("header", F.lit(None).cast("string"))
    if mode == "every":
        return positioned.withColumn("header", text)
    size = 100_000
    chunk = F.floor(F.col(pos) / size).cast("long")
    tagged = positioned.withColumns({"__chunk": chunk, "__name": name})
    lasts = tagged.where(F.pmod(F.col(pos), F.lit(size)) == size - 1).select((F.col("__chunk") + 1).alias("__chunk"), F.col("__name").alias("__before"))
    tagged = tagged.join(lasts, "__chunk", "left")
    previous = F.coalesce(F.lag("__name").over(W.partitionBy("__chunk").orderBy(pos)), F.col("__before"), F.lit(last_name).cast("string"))
    return tagged.withColumn("header", F.when(previous.isNull() | (previous != F.col("__name")), text)).drop("__chunk", "__name", "__before")


def arrival_batches(lines: DataFrame, start: Column, window_ms: int = 250, most_lines: int = 1000, arrival: str = "arrival", tie: str = "seq") -> DataFrame:
    """Add batch_no (arrival window) and sub_no (at most ``most_lines`` lines each).

    The lines are ordered by arrival over all partitions and numbered; a window's
    first number comes from one count a window, so a burst isn't one task's. The
    lines are written before they are ordered, as in ``merge_chronological``.
    """
    elapsed = F.unix_micros(F.col(arrival)) - F.unix_micros(start)
    numbered = lines.withColumn("batch_no", F.floor(elapsed / (window_ms * 1000)).cast("long"))
    placed = with_position(written(numbered, "to-batch").orderBy("batch_no", arrival, tie), "__pos")
    first = placed.groupBy("batch_no").agg(F.min("__pos").alias("__first"))
    joined = placed.join(first.withColumnRenamed("batch_no", "__batch"), F.col("batch_no").eqNullSafe(F.col("__batch")))
    return joined.withColumn("sub_no", F.floor((F.col("__pos") - F.col("__first")) / most_lines).cast("long")).drop("__pos", "__first", "__batch")


def order_batches(batched: DataFrame, arrival: str = "arrival", tie: str = "seq") -> DataFrame:
    """In each batch: rows with a time by time, then the others as they arrived."""
    return batched.orderBy("batch_no", "sub_no", F.col("ts").asc_nulls_last(), F.coalesce("ts_nanos", F.lit(0)), arrival, tie)
