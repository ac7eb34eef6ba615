"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z in lower
case; keys of at least ``least_chars`` code points count. Documents come in
batches, those with the largest ids first. A batch's keys (a 128-bit hash, the
number of documents and the largest document id) are merge-anti-joined with the
sorted runs: keys that no run has become a run of their own, keys that some run
has are written as repeats (a number only). ``fan_in`` runs of one level are
compacted to one run of the next, so a batch meets a logarithmic number of runs.
Runs are Parquet tables bucketed and sorted by hash in the shared folder: the
joins with them don't shuffle them.

Keys found in at least ``least_docs`` documents lose their lines everywhere but
in the document with the largest id, which is where the first batch saw them.

Only DataFrame operations are used. Each row is a document.

Defined results: null and empty texts are one empty line; rows with one id are
separate documents for the count, and all of them keep the line if theirs is the
largest id; a null id is below all others; texts and lines of any length count
whole; an empty table gives an empty result; other columns are kept, but columns
named __lines, __dropped, __kept, __drops, __mine, __own or __id are replaced.

The runs are tables of the session's catalog while the work lasts; they and
their files are dropped at its end.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, partitions, saved, scratch, small_side

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class SortedRuns:
    """Levels of runs of line hashes; each key is in exactly one run."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in, self.buckets = spark, fan_in, partitions(spark)
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self.paths: dict[str, str] = {}
        self.batches: list[str] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        dealt = keys.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        forget(self.spark, self.paths.pop(run))

    def close(self) -> None:
        """Drop all runs and batches: their tables and their files."""
        for run in list(self.paths):
            self._drop(run)
        forget(self.spark, *self.batches)
        self.levels, self.repeats, self.batches = [], [], []

    def add(self, batch: DataFrame) -> None:
        """Take in one batch of (h1, h2, n, keeper), one row a key."""
        met, known = batch, F.lit(False)
        for k, run in enumerate(r for level in self.levels for r in level):
            there = self.spark.table(run).select("h1", "h2", F.lit(True).alias(f"in_{k}"))
            met, known = met.join(there.hint("merge"), ["h1", "h2"], "left"), known | F.col(f"in_{k}").isNotNull()
        if not self.levels:
            self._keep(0, self._write(met))
            return
        met = saved(met.select("h1", "h2", "n", "keeper", known.alias("known")), "line-batch", self.batches)
        self.repeats.append(met.where("known").select("h1", "h2", "n"))
        self._keep(0, self._write(met.where("NOT known").drop("known")))

    def _keep(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            parts = [self.spark.table(r) for r in full]
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            self._keep(level + 1, self._write(merged))
            for r in full:
                self._drop(r)

    def totals(self) -> DataFrame:
        """(h1, h2, n, keeper) of all keys over all batches."""
        rows = [self.spark.table(r).select("h1", "h2", "n", "keeper") for level in self.levels for r in level]
        kind = rows[0].schema["keeper"].dataType
        rows += [r.withColumn("keeper", F.lit(None).cast(kind)) for r in self.repeats]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def own_key() -> Column:
    """What tells rows without an id apart: a hash of the text; null for all others."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def within(ordered: Column, value: Column) -> Column:
    """Is a value in a sorted array? By halving steps, since array_contains looks at all of it."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(ordered))).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(ordered, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
    return F.get(F.transform(F.array(below), lambda n: F.coalesce(F.get(ordered, n - 1) == value, F.lit(False))), F.lit(0))


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """One row for each document and distinct long key: __id, __own (of rows without an id), h1, h2."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= least_chars)
    return docs.select(F.col("doc_id").alias("__id"), own_key().alias("__own"), F.explode(F.transform(F.array_distinct(keys), _hash)).alias("h")).select("__id", "__own", "h.h1", "h.h2")


def deduped(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, batches: int = 4, fan_in: int = 2, most_broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; adds __lines and __dropped."""
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("b")).first()["b"] or []
    number = F.lit(0)
    for b in bounds:
        number = number + F.when(F.col("__id").isNull() | (F.col("__id") <= F.lit(b)), 1).otherwise(0)
    keys = line_keys(docs, least_chars).withColumn("batch", number)
    path = scratch(spark, "line-keys")
    keys.write.partitionBy("batch").parquet(path)
    schema = keys.schema
    keys = spark.read.schema(schema).parquet(path)
    runs = SortedRuns(spark, fan_in)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("keeper")))
    frequent = saved(runs.totals().where(F.col("n") >= least_docs).select("h1", "h2", "keeper"), "frequent-lines")
    hit = keys.join(small_side(frequent, frequent.count(), most_broadcast_rows), ["h1", "h2"]).where(~F.col("__id").eqNullSafe(F.col("keeper")))
    runs.close()
    drops = saved(hit.groupBy("__id", "__own").agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("__drops")), "line-drops")
    forget(spark, path)
    # Hash arrays are wide and grow with the corpus, so the texts are always dealt by id, at any size.
    keyed = docs.withColumn("__mine", own_key())
    joined = keyed.join(drops.hint("merge"), keyed["doc_id"].eqNullSafe(drops["__id"]) & keyed["__mine"].eqNullSafe(drops["__own"]), "left").drop("__id", "__own", "__mine")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("__drops").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(line_key(x)) < least_chars) | ~within(F.col("__drops"), _hash(line_key(x)))))
    out = joined.withColumn("__kept", kept).withColumns({"__lines": F.size(lines).cast("long"), "__dropped": (F.size(lines) - F.size("__kept")).cast("long")})
    return out.withColumn("text", F.array_join("__kept", "\n")).drop("__kept", "__drops")
