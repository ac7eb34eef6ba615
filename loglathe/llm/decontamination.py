"""Benchmark decontamination by templates.

Texts become template tokens: numbers, a unit after a number, and names
(capitalised words within a sentence) are typed placeholders, other words are
themselves in lower case. Windows of ``width`` tokens are hash-joined with the
windows of the benchmark in two forms: as templates, of which a window must have
``literals`` words that are no placeholders, and plain, with every word and
number as it is in lower case, so that whole copies are found whatever they are
made of. Items shorter than a window are one window of their own length. Plain
windows always count. Template windows of one document and one item on one
diagonal (same offset) must be consistent in both directions: a window counts if
each of its slots has the value that most windows of the diagonal give that
value of the item, and the item's value is the one that most windows give the
document's; or if all its slots are equal. So a re-parameterised question
matches, a chance mixture doesn't, and one odd value costs the windows over it.
A document is contaminated by an item if the tokens of the item under windows
that count, each counted once, are ``enough`` (or all of a shorter item).

A fixed-size bitmap of the benchmark's window hashes spares the join most
windows; it only ever passes too many, and the join is exact. Documents are
joined by what they hit: those with the same windows and values in the same
places (copies, or texts that have nothing but one common phrase in common with
the benchmark) are looked up once, and items of the same text are looked up
once, so a phrase of many items and many documents isn't multiplied out.

Defined results: null and empty texts have no windows; texts of any length are
searched whole; null item ids and null document ids are kept as a group; rows of
one id give one result row an item, of the text that matches most; an empty
table gives an empty result; other columns, whatever their names, are ignored;
``exact`` says that all windows that count are word for word.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, saved, small_batches, small_side

#: Words that count as units after a number.
UNITS = frozenset("mm cm m km g kg mg t l ml s ms min h hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees litre litres liter liters byte bytes kb mb gb".split())
#: What a token is; ``templates`` cuts whole arrays of characters by the same rule.
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[.!?\n]")
GAP = re.compile(r"[^\w.,:!?\n]")  # in no token, and not beside a sign that may be in a number
WIDTH, LITERALS, ENOUGH = 8, 4, 13
TEXTS = 256  # texts taken apart at once
BLOCK = 200_000  # characters taken apart at once, to the next gap
HITS = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string()))]))
END, WORD, CAPITAL, NUMBER, UNIT = range(5)
LETTER, DIGIT, STOP, JOINER, NUMERAL, UPPER, TITLE, LOWER = (1 << n for n in range(8))
STEP = 0x9E3779B97F4A7C15 | 1 << 8  # odd, so it has an inverse
BACK = pow(STEP, -1, 1 << 64)


def _mixed(value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


@functools.lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """(what ``TOKEN`` and str's methods say, hash of the lower case) of every code point."""
    every = np.arange(0x110000, dtype="<u4")
    text = every.tobytes().decode("utf-32-le", "surrogatepass")
    bits = np.zeros(len(every), np.uint8)
    for bit, pattern in ((LETTER, r"[^\W\d_]+"), (DIGIT, r"\d+"), (STOP, r"[.!?\n]"), (JOINER, r"[.,:]")):
        for m in re.finditer(pattern, text):
            bits[m.start() : m.end()] |= bit
    for bit, holds in ((NUMERAL, np.char.isdigit), (UPPER, np.char.isupper), (TITLE, np.char.istitle), (LOWER, np.char.islower)):
        bits[holds(every.view("<U1"))] |= bit
    lower = text.replace("\u0130", "i").lower().encode("utf-32-le", "surrogatepass")  # the only one that gets longer
    return bits, _mixed(np.frombuffer(lower, "<u4").astype(np.uint64) + np.uint64(7))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash(low: str) -> int:
    at = code_points()[1]
    return sum(int(at[ord(c)]) * pow(STEP, n, 1 << 64) for n, c in enumerate(low)) % (1 << 64)


@functools.lru_cache(maxsize=1)
def _units() -> np.ndarray:
    return np.array(sorted(map(_hash, UNITS)), np.uint64)


def _cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind, hash of the lower case) of each token; units are told where they stand after a number or are capitalised."""
    bits, lower = code_points()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n, b = len(code), np.append(bits[code], np.uint8(0))
    part = b[:n] & (LETTER | DIGIT | STOP)
    sign = np.nonzero(b & JOINER)[0]
    part[sign[(part[sign - 1] == DIGIT) & (b[sign + 1] & DIGIT > 0) & (sign > 0)]] = DIGIT
    new = part == STOP
    new[:1] = True
    new[1:] |= part[1:] != part[:-1]
    start = np.nonzero(new)[0]
    end = np.append(start[1:], n)
    h = np.add.reduceat(lower[code] * _powers(STEP, n), start) * _powers(BACK, n)[start]
    keep = part[start] > 0
    start, end, h = start[keep], end[keep], h[keep]
    first = b[start]
    kind = np.where(part[start] == STOP, END, np.where(first & NUMERAL > 0, NUMBER, WORD))
    name = np.nonzero((kind == WORD) & (first & UPPER > 0) & (end - start > 1))[0]
    if len(name):
        rest = np.bitwise_or.reduceat(b, np.column_stack([start[name] + 1, end[name]]).ravel())[::2]
        kind[name[rest & (TITLE | LOWER) == LOWER]] = CAPITAL
    if "\u0130" in text or "\u03a3" in text:  # their lower case is longer, or depends on the place in the word
        for i in np.unique(np.searchsorted(start, np.nonzero((code == 0x130) | (code == 0x3A3))[0], "right") - 1):
            h[i] = _hash(text[start[i] : end[i]].lower())
    after = np.append(True, kind[:-1] == NUMBER)[: len(kind)]
    maybe, units = np.nonzero((kind == CAPITAL) | (kind == WORD) & after)[0], _units()
    kind[maybe[units[np.searchsorted(units, h[maybe]) % len(units)] == h[maybe]]] = UNIT
    return start, end, kind, h


class Tokens(NamedTuple):
    """Tokens of several texts (their text, start and end in it), template and plain hashes, slot types (0 none, 1 number, 2 unit, 3 name), numbers of the texts."""

    text: str
    start: np.ndarray
    end: np.ndarray
    typed: np.ndarray
    plain: np.ndarray
    slot: np.ndarray
    row: np.ndarray

    def slots(self, at: int, width: int) -> list[str]:
        """Type and value of each slot of a window."""
        return [f"{'nuv'[self.slot[i] - 1]}:{self.text[self.start[i] : self.end[i]].lower()}" for i in range(at, at + width) if self.slot[i]]


def templates(texts: list[str | None]) -> Tokens:
    """All texts' tokens, ends of sentences left out."""
    text = "\0".join(t or "" for t in texts)
    found, at = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)], 0
    while at < len(text):
        gap = GAP.search(text, at + BLOCK)
        to = gap.end() if gap else len(text)
        start, end, *rest = _cut(text[at:to])
        found.append((start + at, end + at, *rest))
        at = to
    start, end, kind, h = map(np.concatenate, zip(*found, strict=True))
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    row = np.searchsorted(np.cumsum(sizes), start, "right")
    before = np.concatenate([[END], kind[:-1]])[: len(kind)]
    before[1:][row[1:] != row[:-1]] = END
    slot = np.where(kind == NUMBER, 1, np.where((kind == UNIT) & (before == NUMBER), 2, np.where((kind == CAPITAL) & (before != END), 3, 0)))
    keep = np.nonzero(kind != END)[0]
    slot, h = slot[keep], h[keep]
    return Tokens(text, start[keep], end[keep], _mixed(np.where(slot > 0, slot.astype(np.uint64), h)), _mixed(h), slot, row[keep])


def hashes(value: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window at each position."""
    n = len(value) - width + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * np.uint64(0x100000001B3 | 1 << 60) + value[j : j + n]
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def windows(slot: np.ndarray, row: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(template window with enough literal words, window with a slot) at each position; both false across texts."""
    n = len(slot) - width + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(slot == 0)])
    free, within = total[width:] - total[:-width], row[:n] == row[width - 1 :]
    return within & (free >= min(literals, width)), within & (free < width)


def item_windows(benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """One row for each window of each text: item (digest of the text), h, pos, slots, size (template tokens), width.

    A window without slots has the same hash in both forms; others have a second row, plain and without slots.
    """

    def cut(frames):
        for pdf in frames:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                t = templates([text])
                own = min(width, len(t.slot))
                ok, slotted = windows(t.slot, t.row, own, literals)
                h, hp = hashes(t.typed, own), hashes(t.plain, own)
                rows += [(item, int(h[p]), int(p), t.slots(p, own), len(t.slot), own) for p in np.nonzero(ok)[0]]
                rows += [(item, int(hp[p]), int(p), [], len(t.slot), own) for p in np.nonzero(slotted)[0]]
            yield pd.DataFrame(rows, columns=["item", "h", "pos", "slots", "size", "width"])

    texts = benchmark.where("text IS NOT NULL").select(F.md5("text").alias("item"), "text").dropDuplicates(["item"])
    return texts.mapInPandas(cut, "item string, h long, pos int, slots array<string>, size int, width int").distinct()


def bitmap(hashes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of fixed size (32 bits a window, 8 MB at most) of the hashes, gathered by words."""
    bits = min(26, max(16, int(np.ceil(np.log2(max(1, count) * 32)))))
    spot = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(F.shiftright(spot, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(h, %d), 64) as int))" % (64 - bits)).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**20 rows
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out, bits


def _pairs(window: Column) -> Column:
    """Distinct (item's value, document's value) of a window's slots."""
    return F.array_distinct(F.zip_with(window["item_slots"], window["slots"], lambda s, v: F.struct(s.alias("s"), v.alias("v"))))


DIAGONAL = ["hit", "item", "diagonal"]


def refused(slotted: DataFrame) -> DataFrame:
    """(hit, item, diagonal, item_pos) of windows that disagree with most others of their diagonal.

    Each window has one vote for each of its pairs (item's value, document's
    value). A pair is elected if the document's value is the most frequent one for
    the item's, and the item's for the document's (of several the equal one, or
    else the last in order). Votes are counted by grouping, so a diagonal of any
    length is linear.
    """
    differs = F.col("item_slots") != F.col("slots")
    mixed = slotted.groupBy(*DIAGONAL).agg(F.bool_or(differs).alias("differs")).where("differs").drop("differs")
    pairs = slotted.join(mixed, DIAGONAL, "left_semi").select(*DIAGONAL, "item_pos", differs.alias("differs"), F.explode(_pairs(F.struct("item_slots", "slots"))).alias("p")).select(*DIAGONAL, "item_pos", "differs", "p.s", "p.v")
    votes = pairs.groupBy(*DIAGONAL, "s", "v").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("s") == F.col("v")
    most = lambda of, by: F.max(F.struct("n", same.alias("own"), F.col(of).alias("x"))).over(W.partitionBy(*DIAGONAL, by))["x"]
    wrong = votes.withColumns({"for_s": most("v", "s"), "for_v": most("s", "v")}).where((F.col("for_s") != F.col("v")) | (F.col("for_v") != F.col("s")))
    return pairs.where("differs").join(wrong.select(*DIAGONAL, "s", "v"), [*DIAGONAL, "s", "v"], "left_semi").select(*DIAGONAL, "item_pos").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, enough: int = ENOUGH, most_broadcast_rows: int = 500_000) -> DataFrame:
    """Rows (doc_id, item_id, matched_tokens, item_tokens, first_pos, exact) of contaminated documents only."""
    spark = docs.sparkSession
    small_batches(spark)
    done: list[str] = []
    items = saved(item_windows(benchmark, width, literals), "benchmark-windows", done)
    size = F.length(F.concat_ws("", "slots")) + 64
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths"), F.sum(size).alias("bytes")).first()
    passes, bits = bitmap(items.select("h"), facts["n"])
    shared, widths = spark.sparkContext.broadcast(passes), sorted(facts["widths"])  # widths: at most `width`
    kind = docs.schema["doc_id"].dataType.simpleString()

    def probe(batches):
        from xxhash import xxh3_128_hexdigest

        passes = shared.value.view(np.uint64)

        def passing(h, ok):
            at = np.nonzero(ok)[0]
            spot = h[at].view(np.uint64) >> np.uint64(64 - bits)
            return at[(passes[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)].tolist()

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                texts = batch.column(1).slice(start, TEXTS).to_pylist()
                t = templates(texts)
                first, own = np.searchsorted(t.row, np.arange(len(texts))), {}
                for w in widths:
                    ok, slotted = windows(t.slot, t.row, w, literals)
                    h, hp = hashes(t.typed, w), hashes(t.plain, w)
                    found = [(p, int(h[p]), t.slots(p, w)) for p in passing(h, ok)]
                    found += [(p, int(hp[p]), []) for p in passing(hp, slotted)]
                    for p, x, slots in sorted(found):
                        r = int(t.row[p])
                        # the place of a plain window doesn't matter: its first one in the text will do
                        own.setdefault(r, {}).setdefault((x, None if not slots else p), (x, int(p - first[r]), slots))
                rows = []
                for r, windows_ in own.items():
                    at = min(p for _, p, _ in windows_.values())
                    hit = sorted((x, p - at, slots) for x, p, slots in windows_.values())
                    rows.append((start + r, at, xxh3_128_hexdigest(repr(hit).encode("utf-8", "replace")), [{"h": x, "pos": p, "slots": s} for x, p, s in hit]))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], HITS)], names=["doc_id", "at", "hit", "windows"])

    hits = docs.select("doc_id", "text").mapInArrow(probe, f"doc_id {kind}, at int, hit string, windows array<struct<h:long,pos:int,slots:array<string>>>")
    hits = saved(hits, "benchmark-hits")
    distinct = hits.groupBy("hit").agg(F.first("windows").alias("windows")).select("hit", F.explode("windows").alias("w")).select("hit", "w.*")
    there = items.select("item", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "size", "width")
    matched = distinct.join(small_side(there, facts["n"], most_broadcast_rows, facts["bytes"]), "h").where(F.size("slots") == F.size("item_slots"))
    # plain windows are on no diagonal
    diagonal = F.when(F.size("slots") > 0, F.col("pos") - F.col("item_pos"))
    matched = saved(matched.withColumn("diagonal", diagonal).drop("h").distinct(), "benchmark-pairs", done)
    counted = matched.join(refused(matched.where("diagonal IS NOT NULL")), [*DIAGONAL, "item_pos"], "left_anti")
    found = counted.groupBy("hit", "item").agg(
        F.collect_set("item_pos").alias("places"),
        F.max("width").alias("width"),
        F.max("size").alias("item_tokens"),
        F.min("pos").alias("first"),
        F.min(F.col("item_slots") == F.col("slots")).alias("exact"),
    )
    under = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))
    found = found.select("hit", "item", F.size(F.array_distinct(under)).alias("matched_tokens"), "item_tokens", "first", "exact")
    found = saved(found.where(F.col("matched_tokens") >= F.least(F.lit(enough), F.col("item_tokens"))), "benchmark-matches")
    forget(spark, *done)
    named = found.join(benchmark.select("item_id", F.md5("text").alias("item")).distinct(), "item").drop("item")
    rows = hits.drop("windows").join(small_side(named, named.count(), most_broadcast_rows), "hit")
    best = F.max(F.struct("matched_tokens", "exact", (-(F.col("at") + F.col("first"))).alias("back"), "item_tokens"))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.matched_tokens", "x.item_tokens", (-F.col("x.back")).alias("first_pos"), "x.exact")
