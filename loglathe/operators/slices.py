"""Head and tail of each source, by lines or bytes; message lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.lines import block_starts, placed


def skip_lines(numbered: DataFrame, n: int) -> DataFrame:
    return numbered.where(F.col("line_no") >= n)


def last_lines(lines: DataFrame, n: int, by: str = "file") -> DataFrame:
    """The last n lines of each source, with their line_no.

    A first pass counts the lines of each block; only blocks that reach into the
    last n lines are numbered.
    """
    starts = block_starts(lines, F.lit(1), by).where(F.col("__after") < n)
    last = starts.withColumn("__end", F.col("__after"))
    numbered = placed(lines, last, "line_no", F.row_number()).withColumn("line_no", F.col("line_no") - 1)
    back = F.row_number().over(W.partitionBy("file", "block_start").orderBy(F.desc("line_no"))) + F.col("__end")
    return numbered.withColumn("__back", back).where(F.col("__back") <= n).drop("__back", "__end")


def skip_bytes(offset: DataFrame, n: int) -> DataFrame:
    """From byte n of each file on; a line that is cut keeps its rest. Needs raw lines."""
    return _from(offset.withColumn("__first", F.lit(n).cast("long")))


def last_bytes(offset: DataFrame, n: int) -> DataFrame:
    """The last n bytes of each file (all, if it has fewer). Needs raw lines."""
    return _from(offset.withColumn("__first", F.greatest(F.col("file_size") - n, F.lit(0))))


def _from(offset: DataFrame) -> DataFrame:
    cut = F.greatest(F.col("__first") - F.col("start_byte"), F.lit(0)).cast("int")
    kept = offset.where(F.col("start_byte") + F.col("bytes") >= F.col("__first")).where(F.col("__first") < F.col("file_size"))
    rest = F.decode(F.substring(F.encode("line", "UTF-8"), cut + 1, F.octet_length("line")), "UTF-8")
    return kept.withColumn("line", F.when(cut > 0, rest).otherwise(F.col("line"))).drop("__first")


def message_lines(df: DataFrame, column: str) -> DataFrame:
    """One row for each line of a text: part_no (from 0), part."""
    return df.select("*", F.posexplode(F.split(column, "\n")).alias("part_no", "part"))
