"""Document fingerprints by consistent weighted sampling.

A text's terms are its words in lower case, weighted by their counts. For each
of ``samples`` samples and each term there are two gamma variables and a
uniform one, made from the term's hash alone. A term's weight is rounded down
on the term's own logarithmic grid, and the term with the least key is the
sample, together with its grid step. Two fingerprints agree in a share of
samples that estimates the generalised Jaccard similarity of the term weights
(sum of minima over sum of maxima). A sample is kept as 16 bits.

Defined results: null and empty texts, and texts without words, have the
fingerprint of the empty set, which is like itself only; rows with one id
follow each other in order of their texts; null ids come first, and the last
document is followed by the one of the smallest id that is not null; a single
row is its own next; texts of any length count whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches
from .token_files import range_parts

SAMPLES = 128
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def gamma_quantiles() -> np.ndarray:
    """The gamma(2, 1) values below which (n + 1/2) / 2**16 of the distribution lies, by bisection."""
    upper = 1 - (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = (1 + x) * np.exp(-x) > upper
        low, high = np.where(below, x, low), np.where(below, high, x)
    return low.astype(np.float32)


@functools.cache
def sample_seeds(samples: int) -> np.ndarray:
    return (np.arange(1, samples + 1, dtype=np.uint64) * _GOLDEN)[None, :]


def packed_keys(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """One number for each weighted term and sample: the key in order, then 16 bits of the term and its grid step.

    The least number over a text's terms holds the sample's bits in its end. A
    weight of 1 is always at grid step 0, as its logarithm is 0.
    """
    x = hashes[:, None] ^ sample_seeds(samples)
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(29)
    quarters = x.astype("<u8", copy=False).view("<u2").reshape(len(hashes), samples, 4)  # four uniform variables
    half, scale = np.float32(0.5), np.float32(2.0**-16)
    r = gamma_quantiles()[quarters[:, :, 0]]
    steps = np.float32(65535.5) - quarters[:, :, 1]
    steps *= scale  # 1 - beta
    c = quarters[:, :, 2] + half
    c *= quarters[:, :, 3] + half
    c *= scale * scale
    np.log(c, out=c)
    np.negative(c, out=c)  # gamma(2, 1)
    np.log(c, out=c)
    low = np.maximum(hashes & np.uint64(0xFFFF), np.uint64(1))  # 0 is the empty set's
    heavy = np.nonzero(weights > 1)[0]
    if len(heavy):
        beta = 1 - steps[heavy]
        t = np.floor(np.log(weights[heavy].astype(np.float32))[:, None] / r[heavy] + beta)
        steps[heavy] = t - beta + 1
        code = (hashes[heavy] & np.uint64(0xFFFF)).astype(np.int64)[:, None] + t.astype(np.int64) * 0x9E37 & 0xFFFF
        low[heavy] = 0
    steps *= r
    c -= steps
    bits = c.view(np.uint32)
    bits ^= (bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31)  # floats in order as whole numbers
    out = bits.astype(np.uint64)
    out <<= np.uint64(16)
    out |= low[:, None]
    if len(heavy):
        out[heavy] |= np.maximum(code, 1).astype(np.uint64)
    return out


class Sampler:
    """Fingerprints; it keeps the numbers of weighted terms met.

    When ``kept_terms`` are full, those that were met again since the last time
    stay, if they are no more than half; all others are forgotten.
    """

    def __init__(self, samples: int = SAMPLES, kept_terms: int = 100_000, block: int = 256):
        self.samples, self.block = samples, block
        self.slots: dict[tuple[str, int], int] = {}
        self.known = np.zeros((kept_terms, samples), np.uint64)
        self.again = np.zeros(kept_terms, bool)
        self.taken = np.empty((block, samples), np.uint64)

    def make_room(self) -> None:
        at = np.nonzero(self.again)[0]
        if len(at) > len(self.known) // 2:
            at = at[:0]
        place = np.full(len(self.known), -1)
        place[at] = np.arange(len(at))
        for first in range(0, len(at), self.block):  # rows only move towards the front
            part = at[first : first + self.block]
            self.known[first : first + len(part)] = self.known[part]
        moved = place.tolist()
        self.slots = {x: moved[k] for x, k in self.slots.items() if moved[k] >= 0}
        self.again[:] = False

    def least(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """The least number of each sample over at most ``block`` weighted terms."""
        from xxhash import xxh3_64_intdigest

        found = list(map(self.slots.get, terms))
        lack = [x for x, k in zip(terms, found, strict=True) if k is None] if None in found else []
        at = np.array([k for k in found if k is not None] if lack else found, np.intp)
        self.again[at] = True
        own = np.take(self.known, at, axis=0, out=self.taken[: len(at)], mode="clip")
        least = own.min(axis=0, initial=np.iinfo(np.uint64).max)
        if lack:
            hashes = np.array([xxh3_64_intdigest(word.encode("utf-8", "replace")) for word, _ in lack], np.uint64)
            new = packed_keys(hashes, np.array([n for _, n in lack]), self.samples)
            np.minimum(least, new.min(axis=0), out=least)
            if len(self.slots) + len(lack) > len(self.known):
                self.make_room()
            first = len(self.slots)
            self.known[first : first + len(lack)] = new
            self.slots.update(zip(lack, range(first, first + len(lack)), strict=True))
        return least

    def fingerprint(self, text: str) -> np.ndarray:
        """One unsigned 16-bit number for each sample."""
        terms = list(Counter(text.lower().split()).items())
        if not terms:
            return np.zeros(self.samples, np.uint16)
        least = np.full(self.samples, np.iinfo(np.uint64).max)
        for first in range(0, len(terms), self.block):
            np.minimum(least, self.least(terms[first : first + self.block]), out=least)
        return (least & np.uint64(0xFFFF)).astype(np.uint16)


@functools.lru_cache(maxsize=2)
def sampler(samples: int) -> Sampler:
    return Sampler(samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text, samples: int = SAMPLES):
    """Column of hexadecimal fingerprints of whole texts."""
    small_batches()

    @F.arrow_udf("string")
    def hexes(texts: pa.Array) -> pa.Array:
        s = sampler(samples)
        return pa.array([s.fingerprint(x.as_py() or "").astype(">u2").tobytes().hex() for x in texts], pa.string())

    return hexes(text)


def compare_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's start.

    The texts are dealt once, by ranges of the document id; the first document
    of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = range_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", n)
    # one row for each range, so the broadcast below has at most as many rows as there are partitions
    ids = range_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", n)
    firsts = ids.groupBy("__part").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL").orderBy("__part").collect()
    before = spark.createDataFrame([(x["first"], firsts[k - 1]["__part"]) for k, x in enumerate(firsts)], "first long, also int")
    rows = rows.join(F.broadcast(before), F.col("doc_id") == F.col("first"), "left")
    copies = F.filter(F.array(F.struct(F.lit(0).alias("role"), F.col("__part").alias("to")), F.struct(F.lit(1).alias("role"), F.col("also").alias("to"))), lambda x: x["to"].isNotNull())
    dealt = rows.withColumn("c", F.explode(copies)).select("c.to", "c.role", "doc_id", "text")
    dealt = dealt.repartitionById(n, "to").sortWithinPartitions("role", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def compare(batches):
        s = sampler(samples)
        last, last_print, first = None, None, None
        hexed = lambda f: f.astype(">u2").tobytes().hex()

        def edited(row, own, text, other):
            doc, was = row
            half = len(was) // 2
            new = was[: len(was) - half] + text[:half]
            f = s.fingerprint(new)
            return doc, len(was), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), hexed(own), hexed(f), likeness(own, f), likeness(own, other)

        def batch_of(out):
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(names, zip(*out, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)})

        ended = False
        for batch in batches:
            out = []
            for role, doc, text in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                if ended:
                    break
                doc, text = doc.as_py(), text.as_py()
                own = s.fingerprint(text)
                if last is not None:
                    out.append(edited(last, last_print, text, own))
                first = first or (text, own)
                last, last_print, ended = (doc, text), own, role.as_py() == 1
            if out:
                yield batch_of(out)
        if last is not None and not ended:  # a range of null ids alone: its first row follows its last
            yield batch_of([edited(last, last_print, *first)])

    return dealt.mapInArrow(compare, schema)
