"""Token ids as Arrow files of fixed-size-list batches.

The ids of all documents, in ascending id order, form one stream. It is cut by
ranges of the document id into files; within a file the stream is laid out in
sequences of ``seq_len`` ids, a fixed-size list each (16-bit ids where the
vocabulary allows), beside the number of its ids (all, but in a file's last
sequence, which is padded with 0). Record batches have ``batch_rows`` sequences,
so a memory-mapped file gives any sequence, or any document, as a view of the
file without decoding. A mask (1: an id; 0: padding) follows from the number, as
a view of one constant array: ones, then zeros. A mask byte for each id in the
file would cost half as much again as 16-bit ids. Beside ``tokens-N.arrow``
lies ``tokens-N.index.arrow``: doc_id, start within the file, n_tokens.

A task writes under a name of its own attempt; only the names that successful
tasks return are in the manifest, so lost executors leave no wrong file.

Defined results: null and empty texts are documents of the end id alone; rows
with one document id follow each other in order of their ids; null document ids
come first; a text of any length is one document, laid out over as many
sequences as it takes; an empty table gives an empty manifest; other columns,
whatever their names, are ignored.
The folder must be one that every executor can open by pyarrow.
"""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import local_path, partitions, saved, small_batches

MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def range_parts(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Add ``__part``: the number of the id range, of ``n``, that a row falls in.

    The bounds are approximate quantiles of the ids alone, so the wide columns
    are neither sampled nor computed twice.
    """
    shares = [k / n for k in range(1, n)]
    bounds = df.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * n)).alias("b")).first()["b"] if shares else []
    bounds = sorted({int(b) for b in bounds or []})

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(np.array(bounds, np.int64), values, "left").astype(np.int32))

    return df.withColumn("__part", part(F.col(id_col).cast("long")))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", ids_col: str = "ids", seq_len: int = 2048, batch_rows: int = 64, width: int = 4) -> DataFrame:
    """Write packed ids (``ids_col``, binary, ``width`` bytes an id) and return the saved manifest with each file's ``base``."""
    n = partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = np.uint16 if width == 2 else np.uint32
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("length", pa.int32())])

    def write(batches):
        fs, top = local_path(folder)
        fs.create_dir(top, recursive=True)
        name, part, docs_, tokens, left, out, index = uuid.uuid4().hex, None, 0, 0, [], None, None
        block = seq_len * batch_rows

        def put(values, last=False):
            size = len(values) if last else len(values) // block * block
            for at in range(0, size, block):
                own = values[at : min(size, at + block)]
                pad = -len(own) % seq_len
                ids = np.concatenate([own, np.zeros(pad, kind)])
                length = np.full(len(ids) // seq_len, seq_len, np.int32)
                length[len(length) - 1 :] -= pad
                out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), seq_len), pa.array(length)], schema=schema))
            return values[size:]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                part = batch.column(0)[0].as_py()
                paths = [f"{top}/tokens-{part:06d}-{name}{x}.arrow" for x in ("", ".index")]
                files = [fs.open_output_stream(p, compression=None) for p in paths]
                out = pa.ipc.new_file(files[0], schema)
                index = pa.ipc.new_file(files[1], INDEX)
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // width
            starts = tokens + np.cumsum(sizes) - sizes
            index.write_batch(pa.record_batch([batch.column(1), pa.array(starts), pa.array(sizes)], schema=INDEX))
            docs_, tokens = docs_ + batch.num_rows, tokens + int(sizes.sum())
            for x in batch.column(2):
                left.append(np.frombuffer(x.as_buffer(), kind))
                if len(left) >= 256 or len(left[-1]) >= block:
                    left = [put(np.concatenate(left))]
        if out is not None:
            put(np.concatenate([np.zeros(0, kind), *left]), last=True)
            for writer in (out, index):
                writer.close()
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": paths[0], "index_path": paths[1], "n_docs": docs_, "n_tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    parted = range_parts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id", n)
    dealt = parted.select("__part", "doc_id", "ids").repartitionById(n, "__part").sortWithinPartitions("doc_id", "ids")
    manifest = saved(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read from the files: start in the whole stream, number and crc32 of its ids."""

    def read(batches):
        fs, _ = local_path(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f, fs.open_input_file(row["index_path"]) as g:
                    tokens, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    buffer, loaded, done = np.zeros(0, tokens.schema.field(0).type.value_type.to_pandas_dtype()), 0, 0  # ids from `done` on that are loaded
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        crcs = []
                        for start, size in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            more = [buffer[start - done :]]
                            have = len(more[0])
                            while have < size:
                                more.append(tokens.get_batch(loaded).column(0).flatten().to_numpy())
                                loaded, have = loaded + 1, have + len(more[-1])
                            buffer, done = np.concatenate(more) if len(more) > 1 else more[0], start
                            crcs.append(zlib.crc32(buffer[:size].astype("<u4").tobytes()))
                        starts = pa.array(docs.column(1).to_numpy() + row["base"])
                        yield pa.record_batch([docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, partitions(manifest.sparkSession)), "part").mapInArrow(read, DOCUMENTS)


@functools.lru_cache(maxsize=8)
def ones_then_zeros(seq_len: int) -> np.ndarray:
    out = np.repeat(np.array([1, 0], np.uint8), seq_len)
    out.flags.writeable = False
    return out


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of a local file, as a view of the mapped file, and its mask, as a view of a constant array."""
    source = pa.memory_map(path)
    reader = pa.ipc.open_file(source)
    rows = reader.get_batch(0).num_rows
    batch = reader.get_batch(number // rows)
    ids = batch.column(0)[number % rows].values.to_numpy(zero_copy_only=True)
    length, seq_len = batch.column(1)[number % rows].as_py(), len(ids)
    return ids, ones_then_zeros(seq_len)[seq_len - length : 2 * seq_len - length]


def token_files(spark: SparkSession, docs: DataFrame, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """(manifest, documents read back)."""
    manifest = write_token_files(docs, folder, **options)
    return manifest, read_token_files(manifest, folder)
