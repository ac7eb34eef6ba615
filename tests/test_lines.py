"""Rules of decoding, shapes, logfmt, order and slices, on small inputs."""

import os
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.functions import decode, derive, logfmt, render
from loglathe.operators import order, profile, slices
from loglathe.sources import lines as sources
from loglathe.streaming import follow

C = '"level":"INFO","message":"m","method":"GET","url":"/","elapsed":"1ms","request_id":"r","remote_host":"h","user_agent":"a"'
SHAPES = [
    ('{"timestamp":"2025-01-01T00:00:00Z",%s,"status":200,"size":1}' % C, "canonical"),
    ('{"timestamp":"2025-01-01T00:00:00Z",%s,"status":"200","size":1}' % C, "message"),
    ('{"ts":"2025-01-01T00:00Z","msg":"m","severity":"x","threadName":"t","requestId":"r","class":"c","method":"m","source":"s","stackTrace":""}', "java"),
    ('{"ts":"2025-07-30T17:41-07:00","msg":"m","lvl":"info","requestId":"r"}', "message"),
    ('{"timestamp":null,"msg":"m","lvl":"info"}', "message"),
    ('{"timestamp":null,"x":1}', "json"),
    ('{"timestamp":"2025-01-01T00:00:00","msg":"m","lvl":"i"}', "json"),
    ('{"timestamp":"2025-01-01T00:00:00Z","message":"m"}', "time_only"),
    ('{"timestamp":"2025-01-01T00:00:00Z","message":"m","level":"i","elapsed":5}', "time_only"),
    ('{"message":"m","level":"i","host":"a","hostname":"b"}', "json"),
    ('{"message":"m","level":"i","line":-1}', "json"),
    ('{"message":"m","level":"i","status":null,"resource":{"a":[1]}}', "message"),
    ("{}", "json"),
    ('  {"a":1,"a":2}  ', "json"),
    ('"level=info msg=x"', "logfmt"),
    ("level=info msg=x", "text"),
    ("[1]", "text"),
    ("5", "text"),
    ("null", "text"),
    ('{"a":1} x', "text"),
    ('{"a":1}{"b":2}', "text"),
    ('1,"v":2', "text"),
    ("{'a':1}", "text"),
    ('{"a":01}', "text"),
    ("", "text"),
    (None, "text"),
    ('{"level":"INFO","message":"m","line":18446744073709551615}', "message"),
    ('{"level":"INFO","message":"m","line":18446744073709551616}', "json"),
    ('{"level":"INFO","message":"m","size":1e400}', "text"),
    ('{"level":"INFO","message":"Infinity 1e400"}', "message"),
    ('{"message":"m","level":"i","ts":"2025-01-01T00:00:00Z","ts":"2025-01-01T00:00:00Z"}', "json"),
    ('{"message":"m","level":"i","@timestamp":"2025-01-01T00:00:00Z","ts":null}', "json"),
    ('{"message":null,"level":"i"}', "json"),
    ('{"message":"m","level":"i","elapsed":null,"host":null}', "message"),
    ('{"ts":"2025-01-01T00:00:00Z","time":"2025-01-01T00:00:00Z"}', "json"),
    ('{"a":' * 200 + "1" + "}" * 200, "json"),
    ('{"message":"m","level":"i","x":"' + "y" * 2_000_000 + '"}', "message"),
]


def test_shapes(spark):
    decode.configure(spark)
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(SHAPES)], "line_no int, line string")
    got = {r["line_no"]: r["shape"] for r in decode.classified(rows).select("line_no", "shape").collect()}
    assert [got[i] for i in range(len(SHAPES))] == [s for _, s in SHAPES]


def test_aliases_of_all_kinds_of_lines(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from loglathe.plans import queries

    rows = spark.range(48).selectExpr("id AS event_id", "timestamp_micros(1735787045000000 + id) AS ts", "id % 5 AS user_id", "'click' AS event_type", "1.5D AS value", "'{}' AS props")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["resolve_aliases_of_all"]).fetchall())
    got = sorted(map(tuple, queries.QUERIES["resolve_aliases_of_all"](spark, str(tmp_path)).collect()))
    assert got == want and {line for line, _ in got} == {e for e in range(48) if e % 12 not in (6, 7, 8, 9)}


def test_numbers_of_events_without_value_match_the_sql(spark, tmp_path):
    """Cents of 0: no JSON number is shown as 0000."""
    duckdb = pytest.importorskip("duckdb")
    from loglathe.plans import queries

    rows = spark.range(12).selectExpr("id AS event_id", "timestamp_micros(1735787045000000 + id) AS ts", "id % 5 AS user_id", "'click' AS event_type", "element_at(array(0D, -0.004D, 0.5D, 12.3D), cast(id % 4 AS int) + 1) AS value", "'{}' AS props")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["coerce_string_or_number"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["coerce_string_or_number"](spark, str(tmp_path)).collect())) == want


def test_times(spark):
    cases = {"2025-01-02T03:04:05Z": 0, "2025-01-02t03:04:05z": 0, "2025-01-02 03:04:05+00:00": 0, "2025-01-02T05:04:05+02": 0, "2025-01-02T05:04:05+0200": 0, "2025-01-02T03:04:05,123456789Z": 789, "2025-01-02T03:04:05": None, "10:00": None, "2025": None, "1735787045": None}
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", F.unix_seconds(decode.parse_rfc3339(F.col("x"))).alias("s"), decode.nanos_of(F.col("x")).alias("n")).collect()
    for r in rows:
        want = cases[r["x"]]
        assert (r["s"], r["n"]) == (1735787045, want) if want is not None else r["s"] is None


def test_numbers(spark):
    decode.configure(spark)
    cases = {"1e30": "1" + "0" * 30, "1.5e-25": "0." + "0" * 24 + "15", "-2.50E+1": "-25", "5.0": "5", "0.42": "0.42", "1e0": "1", "0e5": "0", "18446744073709551615": "18446744073709551615", "1.7976931348623157e308": "17976931348623157" + "0" * 292, "123456.789e-3": "123.456789"}
    rows = spark.createDataFrame([(c,) for c in cases], "x string").withColumn("v", F.try_parse_json("x"))
    got = {r["x"]: r["t"] for r in rows.select("x", decode.coerce_string_or_number(F.col("v"), F.schema_of_variant("v")).alias("t")).collect()}
    assert got == cases
    line = spark.createDataFrame([('{"level":"INFO","message":"m","line":18446744073709551615,"size":1e30}',)], "line string")
    r = decode.classified(line).select(decode.message_record().alias("r")).first()["r"]
    assert (r["line"], r["size"]) == (2**64 - 1, "1" + "0" * 30)


def test_plans_stay_small(spark):
    decode.configure(spark)
    p = decode.unified_record(decode.classified(spark.createDataFrame([("{}",)], "line string")))
    for df in (p.where("shape = 'message' AND ts IS NOT NULL").select(decode.message_record().alias("r")), decode.dropped(p)):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_logfmt_expressions_match_the_helper(spark):
    r = random.Random(9)
    parts = ["a=1", "b=", "=c", "d", 'e="x y"', r'f="q \" \n"', 'g="open', " ", "  ", "\t", "h=-5", "i=1e3", "j=nan", "k=18446744073709551616", "k=18446744073709551615", "a=2", "é=ü", "\u2003", "l=.5", "m=+7", 'n=x"y', "o==", "\\", "p=0x1", 'q=""', "r=1d"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randint(0, 9))) for _ in range(800)] + [None, "", 'a="' + "\\x" * 20_000, "w " * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", logfmt.parse_logfmt(F.col("t")).alias("p")).withColumn("keys", F.map_keys("p.pairs")).collect()
    for row in rows:
        text, got = texts[row["n"]], row["p"]
        if text is None:
            assert got is None
            continue
        pairs, bare = logfmt.parse_text(text)
        assert got["bare"] == bare and row["keys"] == list(pairs), text[:200]
        for key, (kind, s, i, f) in pairs.items():
            own = got["pairs"][key]
            assert (own["type"], own["s"], own["i"]) == (kind, s, i) and str(own["f"]) == str(f), (text[:200], key)


def test_logfmt():
    p, bare = logfmt.parse_text(r'b=2 a="x \"y\" \n" c= d=-5 =e f=1e3 g="open h i j=18446744073709551616', False)
    assert list(p) == ["", "a", "b", "c", "d", "f", "g"] and bare == []
    assert p["a"][:2] == ("string", 'x "y" n') and p["b"][0] == "int" and p["d"][0] == "float" and p["c"][:2] == ("string", "") and p["g"][1].startswith("open h")
    assert logfmt.parse_text("a=1 a=2 one two")[0]["a"][1] == "2" and logfmt.parse_text("one two")[1] == ["one", "two"]
    assert logfmt.typed("18446744073709551616")[0] == "float" and logfmt.typed("nan")[0] == "float"
    assert logfmt.typed("2025-01-01 00:00:00")[0] == "string" and logfmt.typed("2025-01-01 00:00:00", True)[0] == "timestamp"


def test_location_keeps_the_unbalanced_bracket(spark):
    rows = spark.createDataFrame([(None, None, "a.rs", 3), ("m", "f", "a.rs", None), (None, None, None, 3)], "m string, f string, a string, l int")
    got = [r[0] for r in rows.select(derive.location(F.col("m"), F.col("f"), F.col("a"), F.col("l"))).collect()]
    assert got == ["a.rs:3)", "m::f (a.rs)", None]


def test_sizes_and_values(spark):
    got = spark.range(1).select(*[derive.human_size(F.lit(n).cast("bigint")) for n in (512, 1024, 36159, 3 << 20)]).first()
    assert list(got) == ["512 B", "1 KiB", "35.31 KiB", "3 MiB"]
    assert render.entry_text("k", [1, {"b": None, "a": "x"}]) == '1, { a="x", b=null }'


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.log", "l1\nl2\r\nl3\n\nl5"), ("b.log", "".join(f"x{i}\n" for i in range(2000)))):
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_numbers_offsets_and_slices(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        raw = sources.read_sources(spark, [f"{folder}/*.log"], raw=True)
        numbered = sources.with_line_numbers(raw)
        by = {}
        for r in numbered.collect():
            by.setdefault(os.path.basename(r["file"]), {})[r["line_no"]] = r["line"]
        assert by["b.log"] == {i: f"x{i}" for i in range(2000)} and by["a.log"] == dict(enumerate(["l1", "l2\r", "l3", "", "l5"]))
        name = F.element_at(F.split("file", "/"), -1)
        assert {r["line"] for r in slices.last_lines(numbered, 2).where(name == "a.log").collect()} == {"", "l5"}
        assert slices.skip_lines(numbered, 3).where(name == "a.log").count() == 2
        offset = sources.with_byte_offsets(raw)
        assert [r["line"] for r in slices.last_bytes(offset, 5).where(name == "a.log").orderBy("start_byte").collect()] == ["3", "", "l5"]
        assert slices.last_bytes(offset, 10**6).count() == 2005
        assert [r["line"] for r in slices.skip_bytes(offset, 8).where(name == "a.log").orderBy("start_byte").collect()] == ["3", "", "l5"]
        assert {r["line"] for r in sources.read_lines(spark, str(folder / "a.log")).collect()} == {"l1", "l2", "l3", "", "l5"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(FileNotFoundError):
        sources.expand_paths(spark, [f"{folder}/none*"])


def test_merge_headers_and_profile(spark):
    decode.configure(spark)
    rows = [("/b/x.log", 0, '{"ts":"2025-01-01T00:00:02Z","msg":"m","lvl":"i"}'), ("/a/x.log", 1, "plain"), ("/a/x.log", 0, '{"ts":"2025-01-01T00:00:01Z"}'), ("/a b/y.log", 0, "text")]
    p = decode.unified_record(decode.classified(spark.createDataFrame(rows, "file string, line_no long, line string")))
    merged = order.with_position(order.merge_chronological(decode.dropped(p)))
    got = [(r["file"], r["line_no"], r["header"]) for r in order.source_headers(merged).orderBy("pos").collect()]
    assert got == [("/a/x.log", 0, "==> x.log <=="), ("/b/x.log", 0, None), ("/a/x.log", 1, None), ("/a b/y.log", 0, "==> y.log <==")]
    one = profile.shape_profile(p).first()
    assert (one["total"], one["parse_errors"], one["message_pct"]) == (2, 2, 50.0)
    none = profile.shape_profile(p.limit(0)).first()
    assert (none["total"], none["canonical_pct"]) == (0, 0.0)


def test_positions_are_dense_when_the_range_sampler_samples(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 400_000
        rows = spark.range(0, n, 1, 8).select(F.concat(F.lit("/a/x"), F.col("id") % 4).alias("file"), F.col("id").alias("line_no"), F.timestamp_micros(F.xxhash64("id") % 10**12).alias("ts"), (F.col("id") % 7).cast("int").alias("ts_nanos"), F.concat(F.lit("m"), "id").alias("line"))
        placed = order.with_position(order.merge_chronological(rows))
        got = placed.agg(F.count("line"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.max("file"), F.max("ts_nanos")).first()
        assert list(got)[:4] == [n, n, 0, n - 1]
        taken = placed.where("pos % 1000 = 0").orderBy("pos").collect()
        assert [(r["ts"], r["line_no"]) for r in taken] == sorted((r["ts"], r["line_no"]) for r in taken)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["rotated", "at once", "empty", "mixed"])
def test_merge_of_sorted_runs(spark, kind):
    n = {"empty": 0}.get(kind, 24_000)
    r = spark.range(0, n, 1, 12)
    time = {"rotated": "id", "at once": "id % 2000", "mixed": "id + if(id between 6000 and 7999, -3000, 0)"}.get(kind, "id")
    late = "id % 10 = 0"
    rows = r.select(F.concat(F.lit("/a/x"), F.lpad(F.expr("id div 2000").cast("string"), 3, "0")).alias("file"), F.expr("id % 2000").alias("line_no"), F.expr(f"if({late}, null, timestamp_seconds({time}))").alias("ts"), F.expr(f"if({late}, null, cast(id % 3 AS int))").alias("ts_nanos"), F.concat(F.lit("m"), "id").alias("line"))
    merged = order.merge_sorted(rows)
    got = [tuple(x) for x in merged.orderBy("pos").select("pos", "file", "line_no", "line").collect()]
    want = sorted((x["ts"] is None, x["ts"] or 0, x["ts_nanos"] or 0, x["file"].split("/"), x["line_no"], x["file"], x["line"]) for x in rows.collect())
    assert got == [(k, x[5], x[4], x[6]) for k, x in enumerate(want)]
    # the plan of the runs that are kept has no shuffle, so what is shuffled are the rows of overlapping runs
    shuffled = {"rotated": 0, "empty": 0, "at once": 24_000, "mixed": 6_000}[kind]
    moved = [p for p in _nodes(merged._jdf.queryExecution().analyzed()) if p.nodeName() == "Union"][0].children().apply(1)
    assert DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, moved), spark).count() <= shuffled


def test_follow_orders_each_batch_and_starts_at_the_end(spark, tmp_path):
    decode.configure(spark)
    land = tmp_path / "land"
    land.mkdir()
    (land / "old.log").write_text("old\n")
    old = [r["file"] for r in spark.read.text(str(land)).select(F.col("_metadata")["file_path"].alias("file")).collect()]
    (land / "new.log").write_text('late\n{"ts":"2025-01-01T00:00:02Z","msg":"b","lvl":"i"}\n{"ts":"2025-01-01T00:00:01Z","msg":"a","lvl":"i"}\n')
    stream = follow.follow_lines(spark, f"file://{land}", old)
    follow.follow_merged(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", interval=None).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("batch_id", "pos").collect()
    assert [r["message"] for r in got] == ["a", "b", "late"]
    assert [r["header"] for r in got] == ["==> new.log <==", None, None]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_near_names_of_many_targets(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abAB é") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 12, 13, 20])))
    names, targets = [word() for _ in range(300)] + [None], [word() for _ in range(150)] + [None, "ab"]
    for name in names[:60]:  # some that are near
        t = list(name)
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(t))
            t[at : at + r.randint(0, 1)] = [r.choice("abc")] * r.randint(0, 1)
        targets.append("".join(t))
    got = sorted(map(tuple, profile.similar_to_many(spark.createDataFrame([(n, 1) for n in names], "name string, target int"), spark.createDataFrame([(t,) for t in targets], "target string")).select("target", "name", "distance", "rank").collect()))
    want = []
    for t in {t for t in targets if t is not None}:
        near = sorted((plain_distance(n, t), n) for n in {n for n in names if n is not None} if 1 <= plain_distance(n.lower(), t.lower()) <= 3)
        want += [(t, n, d, k) for k, (d, n) in enumerate(near[:3], 1)]
    assert got == sorted(want)
    assert "CartesianProduct" not in profile.similar_to_many(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("b",)], "target string"))._jdf.queryExecution().executedPlan().toString()


def test_records_are_pruned_by_shape_date_and_time(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "message").otherwise("java").alias("shape"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 20).alias("ts"), F.concat(F.lit("m"), "id").alias("message"))
    rows = rows.unionByName(spark.createDataFrame([("text", None, "none")], "shape string, ts timestamp, message string"))
    sources.write_records(rows, f"{tmp_path}/out", rows_per_file=500)
    whole = spark.read.parquet(f"{tmp_path}/out")
    assert whole.count() == 40_001 and whole.where("ts IS NULL").count() == 1
    found = sources.read_records(spark, f"{tmp_path}/out", "2023-11-18 00:00:00", "2023-11-18 01:00:00", ["java"])
    assert sorted(r["message"] for r in found.collect()) == sorted(r["message"] for r in rows.where("shape = 'java' AND ts >= '2023-11-18' AND ts < '2023-11-18 01:00:00'").collect())
    scan = next(p for p in _nodes(found._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan parquet"))
    assert scan.metrics().apply("numPartitions").value() == 1  # one shape and day
    # each file has a stretch of time of its own
    spans = spark.read.parquet(f"{tmp_path}/out").where("shape = 'java' AND ts IS NOT NULL").groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert len(spans) > 20 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        yield from _nodes(plan.executedPlan())
