"""Batches by number or time, whichever is first; state over restarts; nothing left behind."""

import datetime
import os
import shutil
import time
from urllib.parse import urlparse

from pyspark.sql import functions as F

from loglathe.functions import decode
from loglathe.streaming import batches, follow


def started(spark, top, **kw):
    decode.configure(spark)
    lines = follow.growing_lines(spark, f"file://{top}/land", start="earliest")
    return follow.follow_batches(lines, f"file://{top}/out", f"file://{top}/cp", **kw)


def until(check, seconds=90):
    began = time.time()
    while not (out := check()) and time.time() - began < seconds:
        time.sleep(0.3)
    return out


def rows(spark, top):
    try:
        return [tuple(r) for r in spark.read.parquet(f"file://{top}/out").orderBy("pos").select("batch_no", "pos", "header", "file", "message").collect()]
    except Exception:  # no file yet
        return []


def record(n, text):
    return f'{{"ts":"2025-01-01T00:00:{n:02}Z","msg":"{text}","lvl":"i"}}\n'


def test_number_then_time_then_restart(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.log").write_text(record(9, "a9") + "plain\n" + record(1, "a1") + record(5, "a5") + record(3, "a3"))
    query = started(spark, tmp_path, most_lines=2, window_ms=1500)
    try:
        got = until(lambda: (x := rows(spark, tmp_path)) if len(x := rows(spark, tmp_path)) >= 5 else None)
        # two batches by number at once, the fifth line by the timer
        assert [(b, m) for b, _, _, _, m in got] == [(0, "a9"), (0, "plain"), (1, "a1"), (1, "a5"), (2, "a3")] and [p for _, p, *_ in got] == [0, 1, 2, 3, 4]
        assert [h for _, _, h, _, _ in got] == ["==> a.log <==", None, None, None, None]
    finally:
        query.stop()
    with open(land / "a.log", "a") as f:
        f.write(record(2, "a2"))
    (land / "b.log").write_text(record(1, "b1"))
    query = started(spark, tmp_path, most_lines=2, window_ms=1500)
    try:
        got = until(lambda: (x := rows(spark, tmp_path)) if len(x := rows(spark, tmp_path)) >= 7 else None)
        assert sorted(m for *_, m in got[5:]) == ["a2", "b1"] and got[5][0] == 3 and got[6][1] == 6
        first = got[5]
        # the header goes on after the restart: a.log is shown already
        assert first[2] == (None if first[4] == "a2" else "==> b.log <==")
    finally:
        query.stop()


def test_batches_of_one_processor(spark):
    b = batches.Batches(10, 250, "swap")
    line = lambda name, ts, nanos, text: ("f", name, None, ts, nanos, None, text, text, "text")
    at = datetime.datetime(2025, 1, 1)
    frame, pos, last = b._batch([line("x", None, None, "late"), line("y", at, 5, "second"), line("x", at, 1, "first"), line(None, None, None, "none")], 3, 7, "x")
    assert list(frame["message"]) == ["first", "second", "late", "none"] and list(frame["pos"]) == [7, 8, 9, 10] and (pos, last) == (11, "")
    assert [None if h is None or h != h else h for h in frame["header"]] == [None, "==> y <==", "==> x <==", "==>  <=="]
    assert all(batches.Batches(1, 1, "every")._batch([line("x", at, 0, "a")], 0, 0, "x")[0]["header"] == "==> x <==")
    assert list(batches.Batches(1, 1, "never")._batch([line("x", at, 0, "a")], 0, 0, None)[0]["header"]) == [None]


def test_backlog_in_bounded_micro_batches(spark, tmp_path):
    """What waits is taken in several micro-batches; batches, positions and headers go on over them."""
    land = tmp_path / "land"
    land.mkdir()
    for name in "ab":
        (land / f"{name}.log").write_text("".join(record(n % 60, f"{name}{n}") for n in range(100)))
    decode.configure(spark)
    lines = follow.growing_lines(spark, f"file://{land}", start="earliest", maxBytesPerTrigger=2000)
    query = follow.follow_batches(lines, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", most_lines=30, window_ms=500)
    try:
        follow.wait_for(spark, query, f"file://{tmp_path}/out", 200, 90)
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    got = rows(spark, tmp_path)
    assert len(sizes) > 4 and max(sizes) <= 50 and [p for _, p, *_ in got] == list(range(200)) and len({m for *_, m in got}) == 200
    names = [f for *_, f, _ in got]
    assert [h for _, _, h, _, _ in got] == [f"==> {n} <==" if n != before else None for n, before in zip(names, [None, *names])]


def test_batches_of_a_frame_are_those_of_single_batches():
    b, at = batches.Batches(3, 1, "swap"), datetime.datetime(2025, 1, 1)
    lines = [("f", "xy"[k % 2], at, None if k % 4 == 1 else at.replace(second=(7 * k) % 5), k % 3 or None, None, str(k), str(k), "text") for k in range(12)]
    whole, pos, last = b._batches(batches._frame(lines), 5, 2, "x")
    want, at_pos, name = [], 2, "x"
    for n in range(4):
        part = lines[3 * n : 3 * n + 3]
        for line in sorted((x for x in part if x[3]), key=lambda x: (x[3], x[4] or 0)) + [x for x in part if not x[3]]:
            want.append((5 + n, at_pos, f"==> {line[1]} <==" if line[1] != name else None, line[6]))
            at_pos, name = at_pos + 1, line[1]
    assert list(whole[["batch_no", "pos", "header", "message"]].itertuples(index=False, name=None)) == want and (pos, last) == (at_pos, name)
    assert batches._tuples(batches._frame(lines)) == lines


def test_many_micro_batches_leave_bounded_files(spark, tmp_path):
    """Follow mode on a landing folder: no scratch tables and two header folders at most, and an absent header is no error."""
    decode.configure(spark)
    land, cp = tmp_path / "land", f"file://{tmp_path}/cp"
    land.mkdir()
    scratch = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    for n in range(6):
        (land / f"{n}.log").write_text(record(n, f"m{n}") + "x\n")
        follow.follow_merged(follow.follow_lines(spark, f"file://{land}", []), f"file://{tmp_path}/out", cp, interval=None, name=F.lit("same")).awaitTermination()
        if n == 3:  # as after an upgrade, or a clean-up by hand
            shutil.rmtree(f"{tmp_path}/cp-headers")
    assert len(os.listdir(f"{tmp_path}/cp-headers")) <= 2 and set(os.listdir(scratch)) - before == set()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("batch_id", "pos").collect()
    assert [r["message"] for r in got] == [x for n in range(6) for x in (f"m{n}", "x")]
    assert [r["header"] for r in got if r["pos"] == 0] == ["==> same <==", None, None, None, "==> same <==", None]
