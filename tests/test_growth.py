"""What must not grow with the input, or be done twice: sizes of tasks, samples of ranges over decoded lines."""

import pytest
from pyspark.sql import functions as F

from loglathe.functions import decode
from loglathe.operators import order
from loglathe.plans import landing
from loglathe.sources import lines as sources
from loglathe.streaming import follow


@pytest.fixture
def plans(monkeypatch):
    """Plans of the frames that are written on the way."""
    seen, write = [], order.written
    monkeypatch.setattr(order, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    return seen


def log(spark):
    rows = spark.range(50).selectExpr("concat('/l/', id % 2) AS file", "id AS line_no", "id AS seq", "0L AS block_start", "timestamp_micros(1735787045000000 + id) AS arrival", "concat('{\"ts\":\"2025-01-02T03:04:', 59 - id, 'Z\",\"msg\":\"m\",\"lvl\":\"INFO\"}') AS line")
    decode.configure(spark)
    return rows


def decoded_before_a_range(plan):
    return "rangepartitioning" in plan and "Generate" in plan


def test_spread_by_the_size_of_the_input(spark, tmp_path):
    log(spark).coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    rows = spark.read.parquet(f"{tmp_path}/x.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert sources.spread(rows, "line_no").rdd.getNumPartitions() == cores
    dealt = sources.spread(rows, "line_no", task_bytes=100)
    assert dealt.rdd.getNumPartitions() > cores and dealt.count() == 50


def test_batches_of_follow_are_not_sorted_by_ranges(spark, plans):
    out = follow.ordered_batch(log(spark).drop("line_no", "seq"), 0, most_lines=7).collect()
    assert sorted(r["pos"] for r in out) == list(range(50)) and {r["sub_no"] for r in out} == set(range(8))
    assert plans and not any("rangepartitioning" in p for p in plans)


def test_arrival_batches_are_sampled_after_decoding(spark, plans):
    parsed = decode.dropped(decode.unified_record(decode.classified(log(spark))))
    assert order.arrival_batches(parsed, F.timestamp_micros(F.lit(1735787045000000)), most_lines=7).agg(F.max("sub_no")).first()[0] == 7
    assert not any(map(decoded_before_a_range, plans))


def test_records_are_written_before_they_are_dealt(spark, plans, tmp_path):
    parsed = decode.dropped(decode.unified_record(decode.classified(log(spark))))
    sources.write_records(parsed, f"{tmp_path}/records")
    assert spark.read.parquet(f"{tmp_path}/records").count() == 50
    assert any("Generate" in p for p in plans) and not any(map(decoded_before_a_range, plans))


def test_a_portion_is_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    """The one task of an app only appends files that others have sorted."""
    kept = []
    monkeypatch.setattr(landing, "forget", lambda spark, *paths: kept.extend(paths))
    lines = spark.range(200).selectExpr("id % 2 AS app", "id AS event_id", "concat('line ', id) AS value")
    folder = f"file://{tmp_path}/land"
    assert landing.append_portion(lines.where("event_id < 150").repartition(3), folder, False) == 150
    assert (tmp_path / "land" / "app-1.log").read_text().endswith("line 147\nline 149")
    assert landing.append_portion(lines.where("event_id >= 150"), folder, True) == 50 and landing.append_portion(lines.where("event_id < 0"), folder, False) == 0
    for app in (0, 1):
        assert (tmp_path / "land" / f"app-{app}.log").read_text() == "".join(f"line {k}\n" for k in range(app, 200, 2))
    assert len({r["file"] for r in spark.read.text(f"{kept[0]}/*").selectExpr("_metadata.file_path AS file").collect()}) > 2
