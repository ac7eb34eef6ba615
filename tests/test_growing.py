"""Growing, renamed, truncated and replaced files, against what was written."""

import io
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from loglathe.sources import growing
from loglathe.streaming import follow


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("text", [b"", b"a", b"\n", b"a\n", b"a\nb", b"\n\n\n", b"one\ntwo\nthree\n", b"one\n\ntwo\r\nthree"])
def test_back_to_lines(text):
    for block in (1, 2, 3, 100):
        for n in range(6):
            got = growing.last_lines_start(io.BytesIO(text), len(text), n, block)
            assert text[got:] == b"".join(text.splitlines(keepends=True)[-n:] if n else []) or b"\r" in text
        end = growing.back_to_line_feed(io.BytesIO(text), len(text), 1, block)
        assert end == text.rfind(b"\n") + 1


def test_only_the_last_blocks_are_read():
    file = Counted(b"some line of a log\n" * 1_000_000)
    at = growing.last_lines_start(file, 19_000_000, 10, 4096)
    assert 19_000_000 - at == 190 and file.taken <= 4097


class Stream:
    def __init__(self, spark, top, **options):
        self.spark, self.land, self.out, self.cp, self.options = spark, top / "land", f"file://{top}/out", f"file://{top}/cp", options
        self.land.mkdir()

    def put(self, name, text, mode="a"):
        (self.land / name).parent.mkdir(exist_ok=True)
        with open(self.land / name, mode, newline="") as f:
            f.write(text)

    def step(self):
        """A run to the end of what is there; each is a restart from the checkpoint."""
        lines = follow.growing_lines(self.spark, f"file://{self.land}", **self.options)
        lines.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.cp).trigger(availableNow=True).start().awaitTermination()

    def lines(self, *columns):
        return [tuple(r) for r in self.spark.read.parquet(self.out).orderBy("file", "generation", "start_byte").select(*columns or ("file", "line")).collect()]


def test_appended_lines_come_once_and_unfinished_ones_wait(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put("a.log", "old\nolder\nunfin")
    s.step()
    s.put("a.log", "ished\nnew é\r\n\nhalf")
    s.put("sub/b.log", "first\n")
    s.step()
    s.step()
    assert s.lines() == [("a.log", "unfinished"), ("a.log", "new é"), ("a.log", ""), ("sub/b.log", "first")]
    s.put("a.log", " a line\nlast\n")
    s.step()
    assert s.lines("file", "line", "start_byte")[3:5] == [("a.log", "half a line", 30), ("a.log", "last", 42)]


def test_rename_replacement_truncation_and_copy(spark, tmp_path):
    s = Stream(spark, tmp_path, start="earliest")
    s.put("app.log", "1\n2\n")
    s.step()
    s.put("app.log", "3\n")
    os.rename(s.land / "app.log", s.land / "app.log.1")  # renamed with a line unread
    s.put("app.log", "4\n5\n", "w")
    s.step()
    assert s.lines("file", "line", "generation") == [("app.log", "1", 0), ("app.log", "2", 0), ("app.log", "3", 0), ("app.log", "4", 1), ("app.log", "5", 1)]
    s.put("app.log", "6\n", "w")  # truncated in place
    s.step()
    s.put("app.log", "7\n")
    shutil.copy(s.land / "app.log", s.land / "app.log.2")  # copied, then truncated
    s.put("app.log", "8\n", "w")
    s.step()
    assert sorted(line for _, line in s.lines()) == list("12345678")
    s.put("app.log", "9\n", "w")
    (s.land / "app.log.1").unlink()
    s.step()
    assert sorted(line for _, line in s.lines()) == list("123456789")


def test_last_lines_then_what_follows(spark, tmp_path):
    s = Stream(spark, tmp_path, start=2)
    s.put("a.log", "1\n2\n3\n4")
    s.put("b.log", "x\n")
    s.step()
    assert s.lines() == [("a.log", "2"), ("a.log", "3"), ("b.log", "x")]
    s.put("a.log", "\n5\n")
    s.step()
    assert s.lines() == [("a.log", "2"), ("a.log", "3"), ("a.log", "4"), ("a.log", "5"), ("b.log", "x")]


def test_random_writes_in_small_ranges(spark, tmp_path):
    r, s, want = random.Random(3), Stream(spark, tmp_path, start="earliest", splitBytes=7, blockBytes=3), {}
    for turn in range(4):
        for name in ("a", "b"):
            text = "".join(r.choice(["é", "x", "\n", "long word ", "\n\n"]) for _ in range(r.randint(0, 40)))
            s.put(name, text)
            want[name] = want.get(name, "") + text
        s.step()
    got = {}
    for file, line in s.lines():
        got.setdefault(file, []).append(line)
    assert got == {k: v.split("\n")[:-1] for k, v in want.items() if "\n" in v}


def test_parts_of_a_backlog(tmp_path):
    """Bounded micro-batches take every line once, under the name and generation it has without a bound."""
    r, land = random.Random(5), tmp_path / "land"
    land.mkdir()

    def new(name, turn, mode="w"):
        with open(land / name, mode) as f:
            f.writelines(f"{name}{turn} {k} " + "x" * r.choice([0, 3, 90]) + "\n" for k in range(30))

    def lines(reader, start, end):
        return [(b["file"], b["generation"], b["start_byte"], b["line"]) for p in reader.partitions(start, end) for x in reader.read(p) for b in x.to_pylist()]

    for name in "ab":
        new(name, 0)
    whole = growing.GrowingReader({"path": str(land), "start": "earliest"})
    part = growing.GrowingReader({"path": str(land), "start": "earliest", "maxBytesPerTrigger": "50", "minPartitions": "3"})
    at, want, got = whole.initialOffset(), [], []
    seen = part.initialOffset()
    for turn in range(1, 4):
        end = whole.latestOffset()
        want, at = want + lines(whole, at, end), end
        for step in range(1000):
            if step % 7 == 3:  # a restart: the engine shows the new reader the last offset
                part = growing.GrowingReader({"path": str(land), "start": "earliest", "maxBytesPerTrigger": "50"})
                part.partitions(seen, seen)
            end = part.latestOffset()
            if end == seen:
                break
            taken = lines(part, seen, end)
            size = sum(len(x[3]) + 1 for x in taken)
            assert taken and (size <= 50 or len(taken) == 1)
            got, seen = got + taken, end
            if step == 4 and turn == 2:  # renamed and replaced, while it is read in part
                assert any("source" in x for x in seen["files"].values())
        assert step > 10
        if turn == 1:
            new("a", 1, "a")
            os.rename(land / "a", land / "a.1")
            new("a", 2)
        else:
            new("b", turn)
    assert sorted(got) == sorted(want) and len(got) == len(set(got)) and {x[1] for x in got} == {0, 1}


def test_ranges_are_dealt_to_all_tasks(tmp_path):
    (tmp_path / "a").write_bytes(b"some line of a log\n" * 100_000)
    options = {"path": str(tmp_path), "start": "earliest"}
    count = lambda **kw: len((reader := growing.GrowingReader(options | kw)).partitions(reader.initialOffset(), reader.latestOffset()))
    assert count() == 1 and count(minPartitions="4") == 4 and count(minPartitions="1000") == 8 and count(splitBytes="190000", minPartitions="4") == 10


def test_a_line_beyond_the_bound_is_taken_whole():
    file = io.BytesIO(b"ab\ncd\n" + b"x" * 50 + b"\nlast\n")
    for block in (1, 3, 100):
        assert [growing.line_end(file, 0, n, 62, True, block) for n in (1, 2, 3, 5, 6, 20)] == [3, 3, 3, 3, 6, 6]
        assert growing.line_end(file, 6, 10, 62, True, block) == 57 and growing.line_end(file, 6, 10, 62, False, block) == 6


def test_changes_without_inodes():
    was = {"app": {"id": ":A", "end": 500}}
    assert growing.changes(was, {"app": {"id": ":A", "end": 30}, "app.1": {"id": ":A", "end": 520}}) == [("app.1", "app", 500, 520, 0), ("app", "app", 0, 30, 1)]
    assert growing.changes(was, {"app": {"id": ":A", "end": 700}, "app.1": {"id": ":A", "end": 500}}) == [("app", "app", 500, 700, 0), ("app.1", "app.1", 0, 500, 0)]
    assert growing.changes(was, {"app": {"id": ":A", "end": 500}}) == [] == growing.changes(was, {})
    assert growing.changes({}, {"a": {"id": ":A", "end": 1}}) == [("a", "a", 0, 1, 0)]


def test_a_file_that_is_gone_is_an_error(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n")
    reader = growing.GrowingReader({"path": str(tmp_path), "start": "earliest"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(tmp_path / "a", tmp_path / "b")
    assert [x for b in reader.read(parts[0]) for x in b.column(1).to_pylist()] == ["1", "2"]  # found under its new name
    (tmp_path / "b").unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert list(growing.GrowingReader({"path": str(tmp_path), "failOnDataLoss": "false"}).read(parts[0])) == []
