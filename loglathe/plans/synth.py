"""Log lines made from the ``events`` table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = """
CASE k
WHEN 0 THEN concat('{"timestamp":"', t, '","level":"', lv, '","message":"', m, '","method":"GET","url":"/u/', u, '","status":', st, ',"elapsed":"', c, 'ms","size":', c, ',"request_id":"r', e, '","remote_host":"10.0.0.', u % 250, '","user_agent":"ua/1","user_id":', u, '}')
WHEN 1 THEN concat('{"ts":"', t, '","msg":"', m, '","severity":"', lv, '","thread":"t', u % 8, '","requestid":"r', e, '","class":"com.acme.C', u % 5, '","method":"run","source":"svc","stackTrace":"E: x\\\\n\\\\tat a', u, '\\\\n\\\\tat b","note":"', ty, '"}')
WHEN 2 THEN concat('{"timestamp":"', t, '","level":"', lv, '","message":"', m, '","module":"m', u % 3, '","function":"f","file":"a.rs","line":', u % 100, ',"trace_id":"tr', e, '","zone":"z', u % 2, '"}')
WHEN 3 THEN concat('{"@timestamp":"', t, '","lvl":"', lv, '","msg":"', m, '","requestMethod":"POST","requestUrl":"/p/', u, '","code":', st, ',"responseSize":"', c, '","hostname":"h', u % 4, '","loggerName":"lg","args":"a=1"}')
WHEN 4 THEN concat('{"level":"', lv, '","message":"', m, '","request_id":"r', e, '","extra":{"b":[1,2],"a":', u, '}}')
WHEN 5 THEN concat('{"time":"', t, '","user":', u, ',"kind":"', ty, '"}')
WHEN 6 THEN concat('{"user":', u, ',"kind":"', ty, '","nested":{"x":', e, '}}')
WHEN 7 THEN concat('"level=', lv, ' msg=\\\\"', m, '\\\\" user=', u, ' took=', c, ' ok bare"')
WHEN 8 THEN concat(m, ' plain')
WHEN 9 THEN concat('{"timestamp":"', t, '","level":')
WHEN 10 THEN concat('{"timestamp":"', t, '","level":"', lv, '","message":"', m, '","elapsed":', c, '}')
ELSE concat('{"timestamp":"', t, '","level":"', lv, '","message":"', m, '","host":"a","hostname":"b"}')
END
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr(
        "event_id",
        "cast(ts AS timestamp) AS event_time",
        "event_id % 12 AS k",
        "cast(event_id AS string) AS e",
        "user_id AS u",
        "event_type AS ty",
        "concat('evt ', event_type, ' ', event_id) AS m",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS t",
        "element_at(array('INFO', 'warning', 'ERROR', 'odd'), cast(user_id % 4 AS int) + 1) AS lv",
        "element_at(array(200, 404, 500, 418), cast(user_id % 4 AS int) + 1) AS st",
        "cast(floor(abs(value) * 100) AS bigint) AS c",
        "concat('/logs/d', user_id % 2, '/svc-', user_id % 4, '.log') AS file",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line, event_time): twelve kinds of lines by the event's number; line_no is the event's."""
    return events(spark, sf_dir).select("file", F.col("event_id").alias("line_no"), F.expr(FORMS).alias("line"), "event_time")
