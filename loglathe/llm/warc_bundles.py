"""WARC records in seekable Zstandard bundles.

Each page becomes a WARC record. Records are grouped into independent Zstandard
frames of about ``frame_bytes``; a bundle is the frames one after another and a
footer in the public seekable format (a skippable frame with the compressed and
the plain size of each frame), so any tool that reads Zstandard reads the
bundle as one WARC file, and a reader with the footer unpacks single frames.
The index maps each record to its bundle, frame, offset within the frame and
length.

Equal payloads of at least ``least_revisit`` bytes are stored once: the record
with the largest page id is a response, the others are revisits of it.

Bundles are written under names of the task attempt's own; only those that
successful tasks return are in the index, so a lost executor leaves no wrong
record. The folder must be one that every executor can open by pyarrow.

Defined results: a null html is an empty payload; rows with the same page id
and payload as the response are responses too; a null page id is below all
others; a null url is written as an empty one; a payload over ``frame_bytes`` is
a frame of its own; equal rows are records of one id, each with its own place in
the index; an empty table gives an empty index; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import local_path, partitions, saved, small_batches, small_side

#: Fixed values of the public seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_SPEC = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_size long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id, digest: str) -> str:
    """Page and payload: only rows that are equal in both share an id."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def record(page_id, url: str | None, payload: bytes, digest: str, revisit_of=None, is_revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has no block but says how long the payload was."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_of, digest)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def footer(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_footer(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of an open bundle."""
    size = f.seek(0, io.SEEK_END)
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * count)
    table, out, at = f.read(8 * count), [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def with_revisits(pages: DataFrame, least_revisit: int = 1000, salts: int = 16, most_broadcast_rows: int = 500_000) -> DataFrame:
    """page_id, url, payload, digest, is_revisit, refers_to.

    The digests of repeated payloads (under 100 bytes each) are broadcast up to
    the bound, so payloads stay where they are read. Beyond it the join
    shuffles, and a hot payload's pages are dealt over ``salts`` tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_revisit)
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = saved(last.select(F.col("digest").alias("d"), "last"), "repeated-payloads")
    repeated = last.count()
    if repeated <= most_broadcast_rows:
        found = rows.join(small_side(last, repeated, most_broadcast_rows), F.col("digest") == F.col("d"), "left")
    else:
        last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = rows.withColumn("s", F.pmod(F.xxhash64("page_id"), salts).cast("int"))
        found = spread.join(last.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("s") == F.col("salt")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return found.select("page_id", "url", "payload", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write the bundles and return the saved index, one row a record."""

    def write(batches):
        import zstandard

        fs, top = local_path(folder)
        fs.create_dir(top, recursive=True)
        packer = zstandard.ZstdCompressor(level=level)
        out = path = None
        frames, pending, rows, at, plain = [], [], [], 0, 0

        def flush():
            nonlocal at, pending, plain, rows
            packed = packer.compress(b"".join(pending))
            out.write(packed)
            done = [(*r[:2], path, len(frames), at, len(packed), *r[2:]) for r in rows]
            frames.append((len(packed), plain))
            at, pending, plain, rows = at + len(packed), [], 0, []
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), INDEX, strict=True)], schema=INDEX)

        def close():
            out.write(footer(frames))
            out.close()

        for batch in batches:
            for page, url, payload, digest, revisit, refers in zip(*(batch.column(k) for k in range(6)), strict=True):
                if out is None:
                    path = f"{top}/bundle-{uuid.uuid4().hex}.warc.zst"
                    out, frames, at = fs.open_output_stream(path, compression=None), [], 0
                raw = record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), revisit.as_py())
                rows.append((page.as_py(), record_id(page.as_py(), digest.as_py()), plain, len(raw)))
                pending.append(raw)
                plain += len(raw)
                if plain >= frame_bytes:
                    yield flush()
                    if at >= bundle_bytes:
                        close()
                        out = None
        if out is not None:
            if pending:
                yield flush()
            close()

    small_batches(pages.sparkSession)
    return saved(with_revisits(pages).mapInArrow(write, INDEX_SPEC), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read all records back, frame by frame; payload facts come from the records.

    A revisit's digest and length are those that its record states; a response's
    are computed from its block.
    """

    def read(batches):
        import zstandard

        fs, _ = local_path(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with fs.open_input_file(row["bundle"]) as f:
                    start, packed, plain = read_footer(f)[row["frame"]]
                    f.seek(start)
                    raw = unpacker.decompress(f.read(packed), max_output_size=plain)
                for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                    fields, block = parse_record(raw[offset : offset + length])
                    kind = fields["WARC-Type"]
                    ids = [None if (x := fields.get(k, "::null:").split(":")[2]) == "null" else int(x) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest = hashlib.sha1(block).hexdigest() if kind == "response" else stated
                    if digest != stated:
                        raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
                    out.append((ids[0], int(fields["WARC-Payload-Length"]), digest, kind, ids[1]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    # A frame holds about frame_bytes of records, so a group is bounded.
    frames = index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"), F.collect_list("length").alias("lengths"))
    return frames.repartition(partitions(index.sparkSession), "bundle", "frame").mapInArrow(read, RECORDS)


def read_record(folder: str, row) -> tuple[dict[str, str], bytes]:
    """One record by its index row: only its frame is read and unpacked."""
    import zstandard

    fs, _ = local_path(folder)
    with fs.open_input_file(row["bundle"]) as f:
        f.seek(row["frame_start"])
        with zstandard.ZstdDecompressor().stream_reader(f.read(row["frame_size"])) as stream:
            stream.seek(row["offset"])
            return parse_record(stream.read(row["length"]))
