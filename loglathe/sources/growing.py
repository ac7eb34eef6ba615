"""Lines of files that grow, are renamed, truncated or replaced: a streaming data source.

The offset of the stream is a table of the folder's files: path, identity and the
byte behind the last line feed. A file is told by its inode (where the store has
inodes) and a hash of its head (the first line, or the first 1024 bytes of it),
not by its path. Between two offsets a file goes on where it was if its identity
is the same and it isn't shorter; so a renamed file is read to its end under the
name it had, a copy of a truncated file goes on too, and a new or truncated file
at an old path is read from 0. A file's bytes are dealt to tasks in ranges; a
line belongs to the range that holds its first byte. A last line without a line
feed stays unread until its line feed comes.

Offsets are computed from the folder alone, so a restart from a checkpoint needs
nothing else, and nothing is written by the source.

Options: ``path`` (a folder, of a store that pyarrow opens), ``pattern`` (of the
path below it, default ``*``), ``start`` (``latest``, ``earliest`` or a number:
that many last lines of each file that is there at the start), ``splitBytes``
(most bytes of a task, default 16 MB), ``minPartitions`` (tasks a micro-batch is
dealt to while they have 256 KB each, default 1), ``blockBytes`` (read at once),
``failOnDataLoss`` (default true: an error if a file of an offset is gone before
it was read), ``maxBytesPerTrigger`` (most bytes of a micro-batch, default all:
whole lines, files of the oldest change first, the rest in the micro-batches that
follow; a line that is longer is taken whole). Not for ``availableNow``, which
asks a source of this kind once for its end: it would stop at the first part.
A file that is read in part is marked in the offset with the name and generation
its lines go under, so the rest of a renamed or replaced file keeps them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "file string, line string, start_byte long, bytes long, arrival timestamp, generation int"
ARROW = pa.schema([("file", pa.string()), ("line", pa.string()), ("start_byte", pa.int64()), ("bytes", pa.int64()), ("arrival", pa.timestamp("us", "UTC")), ("generation", pa.int32())])
HEAD_BYTES = 1024
BLOCK_BYTES = 1 << 20
SPLIT_BYTES = 16 << 20
LEAST_SPLIT_BYTES = 256 << 10


def back_to_line_feed(file, end: int, count: int = 1, block: int = BLOCK_BYTES) -> int:
    """The byte behind the ``count``-th line feed before byte ``end``, counted from there back; 0 if there are fewer.

    Reads whole blocks from the end and only as many as it takes.
    """
    while end > 0:
        begin = max(0, end - block)
        file.seek(begin)
        data = file.read(end - begin)
        found = data.count(b"\n")
        if found >= count:
            at = len(data)
            for _ in range(count):
                at = data.rindex(b"\n", 0, at)
            return begin + at + 1
        count, end = count - found, begin
    return 0


def last_lines_start(file, end: int, count: int, block: int = BLOCK_BYTES) -> int:
    """First byte of the last ``count`` lines before byte ``end``; a line feed at the end ends the last one."""
    if count <= 0 or end <= 0:
        return end
    file.seek(end - 1)
    closed = file.read(1) == b"\n"
    return back_to_line_feed(file, end - 1 if closed else end, count, block)


def line_end(file, first: int, most: int, stop: int, beyond: bool, block: int = BLOCK_BYTES) -> int:
    """The end of the last line that ends within ``most`` bytes from ``first`` on, or else ``first``; with ``beyond`` the end of a longer line."""
    at = first + most
    while at > first:
        begin = max(first, at - block)
        file.seek(begin)
        feed = file.read(at - begin).rfind(b"\n")
        if feed >= 0:
            return begin + feed + 1
        at = begin
    at = first + most
    while beyond and at < stop:
        file.seek(at)
        data = file.read(min(block, stop - at))
        feed = data.find(b"\n")
        if feed >= 0:
            return at + feed + 1
        if not data:
            break
        at += len(data)
    return first


def opened(where: str) -> tuple[fs.FileSystem, str]:
    """(store, path) of a folder given as a URI or a local path."""
    if "://" in where or where.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", where))
    return fs.LocalFileSystem(), os.path.abspath(where)


def opened_file(where: str):
    """A file given as a URI or a local path, for random access."""
    store, path = opened(where)
    return store.open_input_file(path)


def _identity(store: fs.FileSystem, path: str, size: int) -> tuple[str, int] | None:
    """(identity, end of the last whole line) of a file, None while it has no whole line."""
    with store.open_input_file(path) as file:
        head = file.read(min(size, HEAD_BYTES))
        at = head.find(b"\n")
        if at < 0 and len(head) < HEAD_BYTES:
            return None
        end = back_to_line_feed(file, size)
        head = head[: at + 1] if at >= 0 else head
    inode = os.stat(path).st_ino if isinstance(store, fs.LocalFileSystem) else ""
    return f"{inode}:{hashlib.sha1(head).hexdigest()}", end


def found_files(where: str, pattern: str = "*") -> dict[str, dict]:
    """path below the folder -> id, end, at (time of the last change); files that go meanwhile are left out."""
    store, top = opened(where)
    out = {}
    for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
        name = info.path[len(top.rstrip("/")) + 1 :]
        if info.type != fs.FileType.File or name.rsplit("/", 1)[-1].startswith(("_", ".")) or not fnmatch.fnmatch(name, pattern):
            continue
        try:
            own = _identity(store, info.path, info.size)
        except FileNotFoundError:
            continue
        if own is not None:
            out[name] = {"id": own[0], "end": own[1], "at": info.mtime_ns // 1000}
    return out


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines that begin in [begin, stop) and end before ``end``; ``name`` is where the file was, ``source`` under which name its lines go."""

    name: str
    source: str
    id: str
    first: int
    begin: int
    stop: int
    end: int
    arrival: int
    generation: int


def _head(identity: str) -> str:
    return identity.split(":", 1)[1]


def changes(start: dict[str, dict], end: dict[str, dict]) -> list[tuple[str, str, int, int, int]]:
    """(name, source, first byte, end byte, generation) of all that is new; the rest of an old file before the new one at its path.

    A file of ``end`` goes on with a file of ``start`` of the same identity (first
    at the same path, then anywhere; then of the same head alone) that isn't
    longer; each is used once.
    """
    free, goes_on = dict(start), {}
    tests = [
        lambda n, m, a, b: n == m and a["id"] == b["id"],
        lambda n, m, a, b: a["id"] == b["id"],
        lambda n, m, a, b: n == m and _head(a["id"]) == _head(b["id"]),
        lambda n, m, a, b: _head(a["id"]) == _head(b["id"]),
    ]
    by_head: dict[str, list[str]] = {}
    for m, b in start.items():
        by_head.setdefault(_head(b["id"]), []).append(m)
    for test in tests:
        for name in sorted(end):
            if name not in goes_on:
                before = next((m for m in by_head.get(_head(end[name]["id"]), ()) if m in free and test(name, m, end[name], free[m]) and free[m]["end"] <= end[name]["end"]), None)
                if before is not None:
                    goes_on[name] = before, free.pop(before)["end"]
    out = []
    for name in sorted(end):
        source, first, generation = name, 0, int(name in start)
        if name in goes_on:
            before, first = goes_on[name]
            source, generation = start[before].get("source", before), start[before].get("generation", 0)
        if first < end[name]["end"]:
            out.append((name, source, first, end[name]["end"], generation))
    return sorted(out, key=lambda x: (x[1], x[4], x[0]))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.where, self.pattern, self.start = options["path"], options.get("pattern", "*"), options.get("start", "latest")
        self.split, self.block = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES))), int(options.get("blockbytes", options.get("blockBytes", BLOCK_BYTES)))
        self.tasks, self.most = int(options.get("minpartitions", options.get("minPartitions", 1))), int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 0)))
        self.first = self.seen = None  # offsets: of the start, of the last micro-batch
        self.strict = str(options.get("failondataloss", options.get("failOnDataLoss", "true"))).lower() == "true"

    def initialOffset(self) -> dict:
        if self.first is None:
            self.first = self._initial()
        return self.first

    def _initial(self) -> dict:
        files = {} if self.start == "earliest" else found_files(self.where, self.pattern)
        if self.start not in ("earliest", "latest"):
            store, top = opened(self.where)
            for name, own in files.items():
                with store.open_input_file(f"{top}/{name}") as file:
                    own["end"] = last_lines_start(file, own["end"], int(self.start), self.block)
        return {"files": files}

    def latestOffset(self) -> dict:
        files = found_files(self.where, self.pattern)
        return {"files": self._part((self.seen or self.initialOffset())["files"], files) if self.most else files}

    def _part(self, start: dict[str, dict], files: dict[str, dict]) -> dict[str, dict]:
        """``files`` up to at most ``most`` bytes beyond ``start``, but one line at least."""
        store, top = opened(self.where)
        out, left = dict(files), self.most
        for name, source, first, stop, generation in sorted(changes(start, files), key=lambda c: (files[c[0]]["at"], c[1], c[4], c[0])):
            end = stop
            if stop - first > left:
                try:
                    with store.open_input_file(f"{top}/{name}") as file:
                        end = line_end(file, first, left, stop, left == self.most, self.block)
                except FileNotFoundError:  # renamed meanwhile; found by the next trigger
                    end = first
                out[name] = files[name] | {"end": end} | ({"source": source, "generation": generation} if end < stop else {})
            left = 0 if end < stop else max(0, left - (end - first))
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = end  # also called with the last offset of the checkpoint, before a restarted stream asks for its end
        new = changes(start["files"], end["files"])
        share = -(-sum(stop - first for _, _, first, stop, _ in new) // self.tasks)
        split = min(self.split, max(share, LEAST_SPLIT_BYTES))
        return [
            Range(name, source, end["files"][name]["id"], first, begin, min(begin + split, stop), stop, end["files"][name]["at"], generation)
            for name, source, first, stop, generation in new
            for begin in range(first, stop, split)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, top = opened(self.where)
        path = self._place(store, top, partition)
        if path is None:
            if self.strict:
                raise FileNotFoundError(f"{partition.name} is gone before its bytes from {partition.begin} were read")
            return
        with store.open_input_file(path) as file:
            at = partition.begin
            if at > partition.first:  # the line before may reach into this range
                file.seek(at - 1)
                while at < partition.stop:
                    data = file.read(min(self.block, partition.end - at + 1))
                    feed = data.find(b"\n")
                    if feed >= 0:
                        at += feed
                        break
                    at += len(data)
                    if not data:
                        return
            file.seek(at)
            rest = b""
            while at < partition.stop:
                data = file.read(min(self.block, partition.end - at - len(rest)))
                if not data:
                    break
                *lines, rest = (rest + data).split(b"\n")
                taken = []
                for line in lines:
                    if at >= partition.stop:
                        break
                    taken.append((line, at))
                    at += len(line) + 1
                if taken:
                    yield self._batch(partition, taken)

    def _place(self, store: fs.FileSystem, top: str, partition: Range) -> str | None:
        """Where the file is now: at its path, or else wherever it was moved."""
        path = f"{top}/{partition.name}"
        info = store.get_file_info(path)
        if info.type == fs.FileType.File and (own := _identity(store, path, info.size)) and own[0] == partition.id and own[1] >= partition.end:
            return path
        long = {name: own["id"] for name, own in found_files(self.where).items() if own["end"] >= partition.end}
        same = [name for name, own in long.items() if own == partition.id] or [name for name, own in long.items() if _head(own) == _head(partition.id)]
        return f"{top}/{same[0]}" if same else None

    def _batch(self, partition: Range, lines: list[tuple[bytes, int]]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.source] * n, pa.string()),
                pa.array([x[:-1].decode("utf-8", "replace") if x.endswith(b"\r") else x.decode("utf-8", "replace") for x, _ in lines], pa.string()),
                pa.array([at for _, at in lines], pa.int64()),
                pa.array([len(x) for x, _ in lines], pa.int64()),
                pa.array([partition.arrival] * n, pa.timestamp("us", "UTC")),
                pa.array([partition.generation] * n, pa.int32()),
            ],
            schema=ARROW,
        )


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))
