"""Counts of shapes and sources; names near a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import SHAPES


def shape_counts(classified: DataFrame) -> DataFrame:
    """Lines of each shape; lines that don't decode are parse_errors."""
    shape = F.when(F.col("shape") == "text", F.lit("parse_errors")).otherwise(F.col("shape"))
    return classified.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def shape_profile(classified: DataFrame) -> DataFrame:
    """One row: counts, totals and percentages; decoding failures are outside the total."""
    found = [s for s in SHAPES if s != "text"]
    counts = classified.agg(*[F.count_if(F.col("shape") == s).alias(s) for s in found], F.lit(0).cast("long").alias("text"), F.count_if(F.col("shape") == "text").alias("parse_errors"))
    counts = counts.withColumn("total", sum((F.col(s) for s in SHAPES[1:]), F.col(SHAPES[0])))
    counts = counts.withColumns({"json_parses": sum((F.col(s) for s in SHAPES[1:5]), F.col(SHAPES[0])), "successful_parses": F.col("total") - F.col("text")})
    share = lambda s: F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col(s) / F.col("total") * 100)
    return counts.withColumns({f"{s}_pct": share(s) for s in [*SHAPES, "parse_errors"]})


def profile_verdict(profile: DataFrame) -> DataFrame:
    share = F.col("canonical_pct")
    return profile.select(F.when(share > 50, "good").when(share > 25, "moderate").otherwise("poor").alias("verdict"), share.alias("canonical_pct"))


def source_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


def similar_sources(names: DataFrame, target: str, k: int = 3, column: str = "name") -> DataFrame:
    """The k names at an edit distance of 1 to 3 (without case), nearest first."""
    near = F.levenshtein(F.lower(column), F.lit(target.lower()), 3)
    return names.select(column).distinct().where(near.between(1, 3)).select(column, F.levenshtein(F.col(column), F.lit(target)).alias("distance")).orderBy("distance", column).limit(k)


#: Parts of a name: of names within three edits, one part at least is whole in both.
EDITS = 3
PARTS = EDITS + 1


def _part(length: Column, k: int) -> tuple[Column, Column]:
    """(place from 0, length) of the k-th of equal parts of a name of this length; longer parts come last."""
    short = F.floor(length / PARTS).cast("int")
    long = length - short * PARTS  # how many parts have one more
    place = short * k + F.greatest(k - (PARTS - long), F.lit(0))
    return place, short + F.when(F.lit(k) >= PARTS - long, 1).otherwise(0)


def name_parts(names: DataFrame) -> DataFrame:
    """An index of distinct names (column ``name``): one row (length, k, part, name) for each part, in lower case."""
    low = names.where("name IS NOT NULL").select("name").distinct().withColumn("low", F.lower("name"))
    parts = []
    for k in range(PARTS):
        place, size = _part(F.length("low"), k)
        parts.append(F.struct(F.lit(k).alias("k"), F.substring(F.col("low"), place + 1, size).alias("part")))
    return low.select("name", F.length("low").alias("length"), F.explode(F.array(*parts)).alias("p")).select("length", "p.k", "p.part", "name")


def _probes(low: Column, length: Column, k: int) -> Column:
    """What the k-th part of a name of this length may be, if ``low`` is near it: array of (k, part)."""
    place, size = _part(length, k)
    moved = F.transform(F.sequence(F.greatest(place - EDITS, F.lit(0)), place + EDITS), lambda at: F.substring(low, at + 1, size))
    return F.transform(F.filter(F.array_distinct(moved), lambda x: F.length(x) == size), lambda x: F.struct(F.lit(k).alias("k"), x.alias("part")))


def similar_to_many(names: DataFrame, targets: DataFrame, k: int = 3, column: str = "name", target: str = "target") -> DataFrame:
    """(target, name, distance, rank): for each target the k names at an edit distance of 1 to 3 (without case), nearest first.

    Names are cut into four parts; three edits leave one of them whole, moved by
    at most three places. So candidates come by equal parts (a join by length,
    number and text of the part), not by comparing all pairs, and the distance
    confirms them.
    """
    index = name_parts(names.select(F.col(column).alias("name")))
    asked = targets.select(F.col(target).alias("target")).where("target IS NOT NULL").distinct().withColumn("low", F.lower("target"))
    lengths = asked.withColumn("length", F.explode(F.sequence(F.greatest(F.length("low") - EDITS, F.lit(0)), F.length("low") + EDITS)))
    asked_parts = [_probes(F.col("low"), F.col("length"), k) for k in range(PARTS)]
    asked = lengths.select("target", "length", F.explode(F.concat(*asked_parts)).alias("p")).select("target", "length", "p.k", "p.part")
    found = asked.join(index, ["length", "k", "part"]).select("target", "name").distinct()
    near = F.levenshtein(F.lower("name"), F.lower("target"), EDITS)
    close = found.where(near.between(1, EDITS)).withColumn("distance", F.levenshtein("name", "target"))
    rank = F.row_number().over(W.partitionBy("target").orderBy("distance", "name"))
    return close.withColumn("rank", rank).where(F.col("rank") <= k)
