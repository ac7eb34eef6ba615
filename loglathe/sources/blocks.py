"""A stored index of the blocks of files: how many lines are before each block.

Files are cut into blocks of ``block_bytes``; a task counts the line feeds of a
block. The index keeps a row for each block, with the size and the time of the
file as they were then. It is extended by the blocks of files that are new or
have changed; rows of a file's former states stay behind and are not used. With
it, lines are numbered and placed block by block without any shuffle, counts
need no file at all, and head, tail and byte slices read only the blocks they
reach into.

A line belongs to the block that holds its first byte. Lines end at a line feed;
one carriage return before it is dropped unless ``raw``. Bytes that aren't UTF-8
are replaced. Files are opened by pyarrow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .growing import last_lines_start, opened_file

BLOCK = 4 << 20
READ = 1 << 20
INDEX = "file string, size long, modified long, begin long, stop long, feeds long, open int"
LINES = "file string, line_no long, start_byte long, bytes long, line string"


def listed(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(file, size, modified) of the files that the patterns match."""
    from .lines import file_statuses

    rows = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in file_statuses(spark, patterns)]
    return spark.createDataFrame(rows, "file string, size long, modified long")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def counted(files: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Index rows of files: line feeds of each block, and whether a file ends without one (in its last block)."""
    size = F.col("size")
    blocks = files.where(size > 0).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(block_bytes).cast("long"))))
    blocks = blocks.withColumn("stop", F.least(F.col("begin") + block_bytes, size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with opened_file(r["file"]) as file:
                    file.seek(r["begin"])
                    left, feeds, data = r["stop"] - r["begin"], 0, b""
                    while left > 0 and (data := file.read(min(READ, left))):
                        feeds, left = feeds + data.count(b"\n"), left - len(data)
                r["feeds"], r["open"] = feeds, int(r["stop"] == r["size"] and not data.endswith(b"\n"))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("size", "modified", "begin", "stop", "feeds")], ("open", pa.int32())]))

    tasks = files.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(tasks, "file", "begin").select("file", "size", "modified", "begin", "stop").mapInArrow(count, INDEX)


def index(spark: SparkSession, patterns: list[str], where: str, block_bytes: int = BLOCK) -> DataFrame:
    """The index of these files: stored in the folder ``where``, and extended by what isn't in it yet.

    Adds ``before``: the line feeds of the file's blocks before this one.
    """
    files = listed(spark, patterns)
    stored = spark.read.schema(INDEX).parquet(f"{where}/*") if _exists(spark, where) else spark.createDataFrame([], INDEX)
    known = stored.select("file", "size", "modified").distinct()
    fresh = files.where("size > 0").join(known, ["file", "size", "modified"], "left_anti")
    if not fresh.isEmpty():
        counted(fresh, block_bytes).write.parquet(f"{where}/{uuid.uuid4().hex}")
        stored = spark.read.schema(INDEX).parquet(f"{where}/*")
    now = stored.join(files, ["file", "size", "modified"], "left_semi").dropDuplicates(["file", "begin"])
    before = W.partitionBy("file").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    return now.withColumn("before", F.coalesce(F.sum("feeds").over(before), F.lit(0)))


def totals(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """(source, file, lines, bytes, lines_before, bytes_before): files of a source in the order of their names; without ``source`` each file is one."""
    files = blocks.groupBy("file").agg((F.sum("feeds") + F.sum("open")).cast("long").alias("lines"), F.max("size").alias("bytes"))
    files = files.withColumn("source", F.col("file") if source is None else source)
    order = W.partitionBy("source").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return files.select("source", "file", "lines", "bytes", *[F.coalesce(F.sum(c).over(order), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("lines", "bytes")])


def lines_of(blocks: DataFrame, raw: bool = False) -> DataFrame:
    """Lines that begin in these blocks of the index: file, line_no and start_byte in the file, bytes, line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened_file(r["file"]) as file:
                    yield from _lines(file, r, raw)

    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.select("file", "size", "begin", "stop", "before").repartition(tasks, "file", "begin").mapInArrow(read, LINES)


def _lines(file, r: dict, raw: bool) -> Iterator[pa.RecordBatch]:
    at, number, stop, size = r["begin"], r["before"], r["stop"], r["size"]
    file.seek(max(at - 1, 0))
    if at and file.read(1) != b"\n":
        while at < stop:  # the rest of a line of the block before
            data = file.read(min(READ, size - at))
            feed = data.find(b"\n")
            at += len(data) if feed < 0 else feed + 1
            if feed >= 0 or not data:
                number += feed >= 0
                break
        file.seek(at)
    rest = b""
    while at < stop:
        data = file.read(min(READ, size - at - len(rest)))
        whole = rest + data
        end = whole.rfind(b"\n") if data else len(whole)
        if end < 0:
            rest = whole
            continue
        values = pc.split_pattern(pa.array([whole[:end]], pa.binary()), b"\n").flatten()
        sizes = pc.binary_length(values).to_numpy().astype("int64")
        starts = at + (sizes + 1).cumsum() - sizes - 1
        n = int((starts < stop).sum())
        yield _batch(r["file"], values[:n], number, starts[:n], sizes[:n], raw)
        at, number, rest = int(starts[-1] + sizes[-1] + 1), number + len(values), whole[end + 1 :]
        if not data:
            return


def _batch(name: str, values: pa.Array, number: int, starts, sizes, raw: bool) -> pa.RecordBatch:
    try:
        text = values.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in values.to_pylist()], pa.string())
    if not raw:
        text = pc.replace_substring_regex(text, "\r$", "", max_replacements=1)
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(number, number + n), pa.int64()), pa.array(starts), pa.array(sizes), text], names=[f.split()[0] for f in LINES.split(", ")])


def numbered_lines(blocks: DataFrame, source: Column | None = None, raw: bool = False) -> DataFrame:
    """All lines with source, line_no and start_byte in their source."""
    return _placed(lines_of(blocks, raw), totals(blocks, source))


def _placed(lines: DataFrame, files: DataFrame) -> DataFrame:
    places = files.select("file", "source", "lines_before", "bytes_before")
    # a row for each file, and the driver lists the files anyway; by its own estimate (of the index, not of what is read by it) Spark would broadcast the lines
    return lines.join(F.broadcast(places), "file").withColumns({"line_no": F.col("line_no") + F.col("lines_before"), "start_byte": F.col("start_byte") + F.col("bytes_before")}).drop("lines_before", "bytes_before")


def _blocks_with_lines(blocks: DataFrame, files: DataFrame, first: Column, last: Column | None = None) -> DataFrame:
    """Blocks that may hold lines from number ``first`` to ``last`` of a source (columns of ``files``); others aren't read."""
    limits = files.select("file", (first - F.col("lines_before")).alias("__first"), *([] if last is None else [(last - F.col("lines_before")).alias("__last")]))
    joined = blocks.join(limits, "file").where(F.col("before") + F.col("feeds") + F.col("open") >= F.col("__first"))
    return (joined if last is None else joined.where(F.col("before") <= F.col("__last"))).drop("__first", "__last")


def lines_from(blocks: DataFrame, n: int, source: Column | None = None) -> DataFrame:
    """Lines from number n of each source on."""
    files = totals(blocks, source)
    return _placed(lines_of(_blocks_with_lines(blocks, files, F.lit(n))), files).where(F.col("line_no") >= n)


def lines_to_the_end(blocks: DataFrame, n: int, source: Column | None = None) -> DataFrame:
    """The last n lines of each source."""
    files = totals(blocks, source)
    first = (F.sum("lines").over(W.partitionBy("source")) - n).alias("__from")
    files = files.select("*", first)
    placed = _placed(lines_of(_blocks_with_lines(blocks, files, F.col("__from"))), files)
    return placed.join(F.broadcast(files.select("file", "__from")), "file").where(F.col("line_no") >= F.col("__from")).drop("__from")


def last_lines_of_files(files: DataFrame, n: int, block_bytes: int = 64 << 10, raw: bool = False) -> DataFrame:
    """(file, back, start_byte, bytes, line) of the last n lines of each file; ``back`` counts from 1 at the end.

    Needs no index: a task goes back from the end of a file, block by block, until
    it has passed n line feeds, and reads only from there.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened_file(r["file"]) as file:
                    start = last_lines_start(file, r["size"], n, block_bytes)
                    own = {"file": r["file"], "begin": start, "before": 0, "stop": r["size"], "size": r["size"]}
                    found = list(_lines(file, own, raw)) if start < r["size"] else []
                total = sum(b.num_rows for b in found)
                for b in found:
                    yield b.set_column(1, "back", pc.subtract(pa.scalar(total, pa.int64()), b.column(1)))

    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.select("file", "size").repartition(tasks, "file").mapInArrow(read, LINES.replace("line_no", "back"))


def last_lines_of_sources(files: DataFrame, n: int, source: Column) -> DataFrame:
    """The last n lines of each source whose files follow each other by name: at most n lines of each file are read."""
    tails = last_lines_of_files(files, n).withColumn("source", source)
    order = W.partitionBy("source").orderBy(F.desc("file"), "back")
    return tails.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)
