"""The block index: numbers, slices and tails against whole files; what is read, and what isn't."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loglathe.sources import blocks


@pytest.fixture
def folder(tmp_path):
    r = random.Random(7)
    (tmp_path / "logs").mkdir()
    made = {"empty": b"", "one": b"x", "feeds": b"\n\n\n", "crlf": b"a\r\nb\r\n\r\nc", "bad": b"\xff\xfe\nok\xff"}
    for k in range(6):
        made[f"r{k}"] = "".join(r.choice(["é", "ab", "\n", "word " * 9, "\n\n", "\r\n"]) for _ in range(r.randint(1, 300))).encode()
    for name, data in made.items():
        (tmp_path / "logs" / name).write_bytes(data)
    return tmp_path, made


def plain(data):
    """(number, start, line) of each line."""
    out, at = [], 0
    parts = data.split(b"\n")
    for k, x in enumerate(parts[:-1] if parts[-1] == b"" else parts):
        out.append((k, at, (x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace")))
        at += len(x) + 1
    return out


def base():
    return F.element_at(F.split("file", "/"), -1)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_numbers_and_offsets(spark, folder, size):
    top, made = folder
    found = blocks.index(spark, [f"{top}/logs/*"], f"file://{top}/index{size}", size)
    got = {}
    for r in blocks.numbered_lines(found).select(base().alias("name"), "line_no", "start_byte", "line").collect():
        got.setdefault(r["name"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(v) for k, v in made.items() if v}
    counts = {os.path.basename(r["file"]): (r["lines"], r["bytes"]) for r in blocks.totals(found).collect()}
    assert counts == {k: (len(plain(v)), len(v)) for k, v in made.items() if v}


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_slices_of_sources(spark, folder, n):
    """Sources are made of several files: names that begin alike."""
    top, made = folder
    source = F.substring(base(), 1, 1)
    found = blocks.index(spark, [f"{top}/logs/*"], f"file://{top}/index", 16)
    want = {}
    for name in sorted(made):
        want.setdefault(name[0], []).extend(x for _, _, x in plain(made[name]))
    rows = lambda df, key: {s: [r["line"] for r in sorted(df.where(F.col("source") == s).collect(), key=key)] for s in want}
    assert rows(blocks.lines_from(found, n, source), lambda r: r["line_no"]) == {k: v[n:] for k, v in want.items()}
    assert rows(blocks.lines_to_the_end(found, n, source), lambda r: r["line_no"]) == {k: v[-n:] if n else [] for k, v in want.items()}
    files = blocks.listed(spark, [f"{top}/logs/*"])
    assert rows(blocks.last_lines_of_sources(files, n, source), lambda r: -r["back"]) == {k: v[-n:] if n else [] for k, v in want.items()}


def test_a_changed_file_is_counted_anew_and_others_are_not(spark, folder):
    top, made = folder
    where = f"file://{top}/index"
    first = blocks.index(spark, [f"{top}/logs/*"], where, 16).collect()
    assert len(os.listdir(f"{top}/index")) == 1
    assert sorted(blocks.index(spark, [f"{top}/logs/*"], where, 16).collect()) == sorted(first) and len(os.listdir(f"{top}/index")) == 1
    with open(top / "logs" / "one", "ab") as f:
        f.write(b"\nmore\n")
    (top / "logs" / "new").write_bytes(b"n\n" * 20)
    again = blocks.index(spark, [f"{top}/logs/*"], where, 16)
    added = spark.read.parquet(*[f"{top}/index/{d}" for d in os.listdir(f"{top}/index")]).exceptAll(spark.createDataFrame(first).select("file", "size", "modified", "begin", "stop", "feeds", "open"))
    assert {os.path.basename(r["file"]) for r in added.collect()} == {"one", "new"}
    counts = {os.path.basename(r["file"]): r["lines"] for r in blocks.totals(again).collect()}
    assert counts["one"] == 2 and counts["new"] == 20 and counts["r0"] == len(plain(made["r0"]))
    (top / "logs" / "new").unlink()
    assert "new" not in {os.path.basename(r["file"]) for r in blocks.index(spark, [f"{top}/logs/*"], where, 16).collect()}


def test_only_blocks_that_hold_the_lines_are_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"some line of a log\n" * 100_000)
    found = blocks.index(spark, [f"{tmp_path}/a"], f"file://{tmp_path}/index", 1 << 16)
    files = blocks.totals(found)
    assert found.count() == 29
    assert blocks._blocks_with_lines(found, files, F.lit(99_990)).count() == 1 and blocks._blocks_with_lines(found, files, F.lit(50_000), F.lit(50_001)).count() <= 2
    assert blocks.lines_to_the_end(found, 3).count() == 3


@pytest.mark.parametrize("cut", [blocks.numbered_lines, lambda b: blocks.lines_from(b, 2), lambda b: blocks.lines_to_the_end(b, 2)])
def test_lines_are_never_broadcast(spark, folder, cut):
    """Spark takes the lines for as small as the index they are read by."""
    top, _ = folder
    found = blocks.index(spark, [f"{top}/logs/*"], f"file://{top}/index", 16)
    nodes = cut(found)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sent = [k for k, line in enumerate(nodes) if "BroadcastExchange" in line]
    assert sent
    for k in sent:
        below = nodes[k + 1 :]
        below = below[: next((i for i, line in enumerate(below) if depth(line) <= depth(nodes[k])), len(below))]
        assert not any("MapInArrow" in line for line in below)
