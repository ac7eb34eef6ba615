"""A training-text pipeline of five stages; each one works on all that the one before kept.

Defined results, for every stage: null and empty texts stay, as long as nothing
is taken from them; rows with a null id stay, except toxic ones and ones that
lose all their lines; rows of one id and one text fare alike; texts of any length
are judged whole; an empty table gives an empty one; columns beyond those of
documents are passed on, whatever their names (but names that begin with two
underscores are the stages' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import bpe, decontamination, line_runs, odd_sketches, toxicity
from loglathe.llm.queries import held_out
from loglathe.llm.shared import saved, small_side, table

MOST_BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id isn't in ``ids`` (one column, doc_id); rows with a null id stay."""
    gone = saved(ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct(), "dropped-ids")
    return docs.join(small_side(gone, gone.count(), MOST_BROADCAST_ROWS), docs["doc_id"] == gone["__gone"], "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score of 0.5 or more go; without usable labels none does."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), eligible=~held_out())
    return docs.withColumn("__score", toxicity.score(F.col("text"), model, spark)).where("__score < 0.5").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated lines; n_chars follows; a document that had text and has none left goes."""
    out = line_runs.deduped(docs)
    emptied = (F.col("__dropped") > 0) & (F.btrim(F.col("text"), F.lit(line_runs.BLANKS)) == "")
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays."""
    found = odd_sketches.linked(docs, words=5, similarity="0.8")
    return without(docs, found.where("NOT kept").select("doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or enough of it, go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text; ``exact`` says that they decode to the text."""
    coded = docs.withColumn("__coded", bpe.round_trip(F.col("text")))
    exact = F.col("__coded.text") == F.coalesce("text", F.lit(""))
    return coded.withColumns({"ids": F.col("__coded.ids"), "n_tokens": F.size("__coded.ids").cast("long"), "exact": exact}).drop("text", "__coded")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The classifier and the component search have no SQL form; tests/llm/test_pipeline.py compares each stage with plain Python.
ORACLE_SQL = None
