"""Phrase collocations by dynamic itemset counting.

Documents are dealt into ``shards`` shards, which are scanned one after the
other, again and again. Words are counted from the start. A longer phrase is
active as soon as both its subphrases (without its last and without its first
word) have been counted ``least`` times, wherever the scan then is; it is counted
in the shards that follow, until it has seen each shard once (one full cycle).
So lengths are interleaved: pairs are counted while words still are, and its
count is exact when the cycle is over. The work ends when no phrase is active.

Nothing enumerates the possible phrases: the step at which a subphrase passed
the threshold is kept beside it, and a phrase met in a shard is counted if the
later of its two steps is within the last cycle. Tasks take texts apart a few MB
at a time and send each different phrase once with its count; two bitmaps of
fixed size (phrases that have passed; those that passed within the last cycle)
spare them most others. A bitmap only lets too many pass; joins with the table
of passed phrases decide. A first pass over the texts counts words, pairs and
triples by hash in three tables of fixed size; what shares its place with less
than ``least`` occurrences can't reach the threshold and isn't counted at all.
This sieve too only ever lets too many pass. Shuffle files go as soon as the step
that wrote them is stored, so the disk holds those of one step, not of all.

Words are in lower case (A-Z only), pieces end at punctuation and line breaks,
and everything is counted for each language by itself.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows and null ids count like all others; texts of any length are counted
whole; ties are broken as the ranking says (score, count, phrase in the order of
its bytes); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from xxhash import xxh3_64_intdigest

from .shared import forget, saved, scratch, shuffles_dropped, small_batches

LONGEST = 4
#: Bits of a bitmap: fixed, whatever the corpus; a full one costs time, never results.
BITS = 24
TEXT_BYTES = 8 << 20  # taken apart at once
CHUNK = 1 << 12  # places of the sieve in one row
BREAK = b"A"  # no word has a capital letter by then
TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = re.compile(rb"[.,;:!?\n-\r]")
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spaced(text: bytes) -> bytes:
    """Words in lower case between blanks; ``BREAK`` between pieces."""
    return text.translate(TABLE).replace(b"\n", b" " + BREAK + b" ")


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of each word (of a dictionary) and its language."""
    own = np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B1 % 2**64)
    return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)) ^ own


def _longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    with np.errstate(over="ignore"):
        h = left * MULTIPLIER + right
        return h ^ (h >> np.uint64(29))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * MULTIPLIER) >> np.uint64(64 - bits)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slots(hashes, 5 + len(bitmap).bit_length())
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


class Maps(NamedTuple):
    """Bitmaps by hash: phrases that have passed, those of the last cycle; words, pairs and triples that may reach the threshold."""

    passed: np.ndarray
    recent: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray


def _tally(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key's group, a place of each group, its size)."""
    codes, _ = pd.factorize(keys)
    groups = int(codes.max()) + 1 if len(codes) else 0
    first = np.zeros(groups, np.int64)
    first[codes] = places
    return codes, first, np.bincount(codes, minlength=groups)


def _coded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(number of each word in the dictionary, the dictionary); number 0 is a break, 1 no word at all and not among them."""
    ends = (b" " + BREAK) * LONGEST
    text = BREAK + b"  " + _spaced(b"\n".join(texts)) + ends
    coded = pc.split_pattern(pa.array([text], pa.large_binary()), b" ").flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    return at[at != 1].astype(np.int64), coded.dictionary.cast(pa.binary())


def _counts(lang: str, texts: list[bytes], with_words: bool, maps: Maps) -> Iterator[pa.RecordBatch]:
    """Counts of words (if wanted) and of phrases that may be active, over texts of one language."""
    at, dictionary = _coded(texts)
    kinds = len(dictionary)

    def batch(size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), phrases.cast(pa.string()), pa.array(n, pa.int64())], schema=COUNTS)

    own = _word_hashes(dictionary, lang)
    if with_words:
        n = np.bincount(at, minlength=kinds)
        yield batch(0, pa.array([b""], pa.binary()), np.array([n[2:].sum()]))
        able = np.nonzero(_in(maps.words, own))[0]
        able = able[able > 1]
        yield batch(1, dictionary.take(pa.array(able)), n[able])
    frequent, fresh = _in(maps.passed, own), _in(maps.recent, own)
    frequent[0] = False  # a break
    there, new, h = frequent[at], fresh[at], own[at]  # of the phrase that begins at each place
    codes, h1 = at, own[at]
    for size in range(2, LONGEST + 1):
        places = np.nonzero(there[:-1] & there[1:])[0]
        places = places[places < len(at) - size + 1]
        longer = _longer(h[places], h1[places + size - 1])
        if size < LONGEST:
            able = _in(maps.pairs if size == 2 else maps.triples, longer)
            places, longer = places[able], longer[able]
        if not len(places):
            return
        group, first, n = _tally(codes[places] * kinds + at[places + size - 1], places)
        counted = np.bincount(group, weights=new[places] | new[places + 1], minlength=len(n)) > 0
        chosen = first[counted]
        if len(chosen):
            parts = [dictionary.take(pa.array(at[chosen + k])) for k in range(size)]
            yield batch(size, pc.binary_join_element_wise(*parts, b" "), n[counted])
        if size == LONGEST:
            return
        there, new, h, codes = np.zeros(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        there[places], new[places], h[places], codes[places] = _in(maps.passed, longer), _in(maps.recent, longer), longer, group


def _cut(text: bytes, most: int = TEXT_BYTES) -> Iterator[bytes]:
    """A text in parts of a few MB, cut where a piece ends."""
    begin = 0
    while len(text) - begin > 2 * most and (end := END.search(text, begin + most)):
        yield text[begin : end.end()]
        begin = end.end()
    yield text[begin:]


def _by_language(batches: Iterator[pa.RecordBatch], use: Callable[[str, list[bytes]], Iterator]) -> Iterator:
    """``use`` of some MB of texts of one language at a time."""
    held, size = {}, 0

    def flush() -> Iterator:
        for lang, own in held.items():
            yield from use(lang, own)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part in _cut(text.as_py()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= TEXT_BYTES:
                    yield from flush()
                    size = 0
    yield from flush()


def sieve(texts: DataFrame, least: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the hashes of words, of pairs and of triples whose places have ``least`` occurrences or more.

    Each task counts in three tables of one byte a place and sends them once; so few
    tasks (two a core) take many files each, whatever the size of the corpus.
    """
    spark, most = texts.sparkSession, min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((3, 1 << bits), np.uint8)

        def count(lang: str, own: list[bytes]) -> Iterator:
            at, dictionary = _coded(own)
            h = _word_hashes(dictionary, lang)
            n = np.bincount(at, minlength=len(h))
            n[:2] = 0
            whole = pd.Series(n).groupby(_slots(h, bits)).sum()
            add(0, whole.index.to_numpy(), whole.to_numpy())
            first, longer = np.nonzero(at)[0], h[at[at > 0]]
            for k in (1, 2):
                more = at[first + k] > 0  # texts end with breaks
                first, longer = first[more], longer[more]
                longer = _longer(longer, h[at[first + k]])
                slots = _slots(longer, bits).view(np.int64)
                _, place, size = _tally(slots, np.arange(len(slots)))
                add(k, slots[place], size)
            return iter(())

        def add(k: int, places: np.ndarray, n: np.ndarray) -> None:
            places = places.astype(np.int64)
            tables[k][places] = np.minimum(tables[k][places] + n, 255)

        for _ in _by_language(batches, count):
            pass
        chunks = tables.reshape(-1, CHUNK)
        for number in np.nonzero(chunks.any(axis=1))[0]:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "counts": pa.array([chunks[number].tobytes()], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "able": pa.array([np.packbits(total >= most, bitorder="little").tobytes()], pa.binary())})

    dealt = texts.select("lang", "text").coalesce(2 * spark.sparkContext.defaultParallelism)
    found = dealt.mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(merge, "chunk int, able binary")
    out = np.zeros((3 << bits) // 64, np.uint64)
    for r in found.toLocalIterator():  # a bit a place
        out[r["chunk"] * CHUNK // 64 : (r["chunk"] + 1) * CHUNK // 64] = np.frombuffer(r["able"], np.uint64)
    return tuple(out.reshape(3, -1))


def scan(texts: DataFrame, with_words: bool, maps: Maps) -> DataFrame:
    """(lang, size, phrase, n) of a shard; size 0 is the number of words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(maps)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_language(batches, lambda lang, own: _counts(lang, own, with_words, shared.value))

    return texts.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, n long")


def bitmap(phrases: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the hashes of (lang, size, phrase); what is collected has a fixed bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (lang, size), own in frame.groupby(["lang", "size"]):
                flat = pa.array([w for p in own["phrase"] for w in p.encode().split(b" ")], pa.binary()).dictionary_encode()
                words = _word_hashes(flat.dictionary, lang)[flat.indices.to_numpy()].reshape(-1, size)
                h = words[:, 0]
                for k in range(1, size):
                    h = _longer(h, words[:, k])
                slots = _slots(h, bits)
                yield pa.RecordBatch.from_pydict({"word": pa.array((slots >> np.uint64(6)).astype(np.int32)), "bit": pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))})

    found = phrases.select("lang", "size", "phrase").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    frame = found.toPandas()  # at most one row for each word of the bitmap
    out[frame["word"].to_numpy(dtype=np.int64)] = frame["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _first(phrase: Column, words) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), words)


def _rest(phrase: Column, first: Column) -> Column:
    return F.substring(phrase, F.length(first) + 2, F.length(phrase))


def counted(docs: DataFrame, least: int = 30, shards: int = 2, bits: int = BITS) -> DataFrame:
    """(lang, size, phrase, n): words and phrases of up to four words found at least ``least`` times; size 0: all words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "phrase-shards")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").parquet(folder)
    texts = spark.read.schema("lang string, text string, shard int").parquet(folder)
    kind = "lang string, size int, phrase string, n long, start int, step int"
    able = sieve(texts, least, bits)
    totals, until, cohorts, t = spark.createDataFrame([], kind), [], [], 0
    while True:
        recent = [m for m in cohorts[-shards:] if m.any()]
        if t >= shards and not recent:
            break
        empty = np.zeros(1 << bits - 6, np.uint64)
        both = [np.bitwise_or.reduce([empty, *maps]) for maps in (cohorts, recent)]
        shard, rows = texts.where(F.col("shard") == t % shards), totals
        total = lambda found: found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
        if t < shards:  # words by a scan of their own: two filters on one scan would go below the grouping and do all of it twice
            words = total(scan(shard, True, Maps(empty, empty, *able)))
            rows = rows.unionByName(words.withColumn("start", F.lit(0)).withColumn("step", F.lit(None).cast("int")))
        if t:
            passed = totals.where("step IS NOT NULL").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("step").alias("__step"))
            left, right = passed.toDF("lang", "__left", "__a"), passed.toDF("lang", "__right", "__b")
            grams = total(scan(shard, False, Maps(*both, *able))).withColumn("__left", _first(F.col("phrase"), F.col("size") - 1)).withColumn("__right", _rest(F.col("phrase"), _first(F.col("phrase"), F.lit(1))))
            grams = grams.join(left, ["lang", "__left"]).join(right, ["lang", "__right"]).withColumn("start", F.greatest("__a", "__b")).where(F.col("start") > t - shards)
            rows = rows.unionByName(grams.select("lang", "size", "phrase", "n", "start", F.lit(None).cast("int").alias("step")))
        merged = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("step").alias("step"))
        step = F.coalesce("step", F.when((F.col("size") > 0) & (F.col("n") >= least), F.lit(t + 1)))
        merged = merged.withColumn("step", step).where((F.col("size") == 0) | F.col("step").isNotNull() | (F.col("start") + shards > t + 1))
        done, until = until, []
        with shuffles_dropped(spark):
            totals = saved(merged, "phrase-counts", until)
        forget(spark, *done)
        cohorts.append(bitmap(totals.where((F.col("step") == t + 1) & F.col("size").between(1, LONGEST - 1)), bits))
        t += 1
    forget(spark, folder)
    return totals.where("size = 0 OR step IS NOT NULL").select("lang", "size", "phrase", "n")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, size, phrase, a, l, r, score) with the cut of the lowest score; exact in decimals."""
    candidates = counts.where("size >= 2").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("__first", _first(F.col("phrase"), F.col("k"))).withColumn("__rest", _rest(F.col("phrase"), F.col("__first")))
    parts = counts.where("size BETWEEN 1 AND 3")
    named = lambda part, n: parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(named("__first", "l"), ["lang", "__first"]).join(named("__rest", "r"), ["lang", "__rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("__best"))
    return best.select("lang", "size", "phrase", "a", "__best.l", "__best.r", "__best.score")


def uncovered(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those that a longer one accounts for."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return kept.where(F.col("__longer").isNull() | (wide("__longer") * 100 < wide("a") * percent)).drop("__longer")


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, percent: int = 80, shards: int = 2, bits: int = BITS) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    counts = counted(docs, least, shards, bits)
    with shuffles_dropped(docs.sparkSession):
        scores = saved(scored(counts), "phrase-scores")
    found = uncovered(scores, percent)
    order = [F.desc("score"), F.desc("a"), F.encode("phrase", "UTF-8")]
    # in two levels, so that a language isn't one task's
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    ahead = found.withColumn("__part", part).withColumn("__at", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__at") <= first)
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    words = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
