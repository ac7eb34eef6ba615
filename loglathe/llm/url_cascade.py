"""URL rules by a Bloom filter cascade.

A rule is (verdict, host, path): it fits its host and all subdomains if the
url's path starts with the rule's. The keys a url could match are its host
suffixes joined with its path prefixes, of the label counts and path lengths
that rules have. All keys of the corpus form the universe. The first level of
the cascade is a Bloom filter of the listed keys, the second of the unlisted
keys that the first one passes, the third of the listed keys that the second
one passes, and so on until a level has no false positive: membership is exact
for every key of the corpus, and a lookup is bit tests on constants, with no
join. A second cascade over the listed keys alone tells blocked from allowed.
The longest listed key of a url is its rule; a url without one is allowed.

The levels' size follows the number of rules (and the logarithm of the number
of keys), not the corpus; ``most_bits`` guards it.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; equal urls are judged alike; a url of any length is judged whole;
an empty table gives an empty result; other columns are kept, but columns named
host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import math
import string
import sys
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.translate(F.coalesce(found, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of so many labels, joined with path prefixes of such lengths."""
    parts = F.split(host, r"\.")
    fits = lambda n: F.size(parts) >= n
    suffixes = F.filter(F.array(*[F.when(fits(n), F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")) for n in labels]), lambda s: s.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _spots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one, two = F.xxhash64(F.lit(level), key), F.xxhash64(F.lit(-level), key)
    size = F.lit(bits).cast("long")
    return [F.pmod(F.pmod(one, size) + F.lit(i) * F.pmod(two, size), size) for i in range(hashes)]


class Cascade:
    """Exact membership of ``listed`` within ``listed`` and ``universe`` (one string column ``key`` each)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, most_bits: int = 1 << 26, most_levels: int = 64):
        listed = saved(listed.select("key").where("key IS NOT NULL").distinct(), "cascade-listed")
        others = saved(universe.select("key").where("key IS NOT NULL").distinct().join(listed, "key", "left_anti"), "cascade-universe")
        inside, outside = listed, others
        n, m = inside.count(), outside.count()
        self.levels: list[tuple[Column, int, int]] = []  # each level's bits are one literal, however often they are tested
        while n:
            if len(self.levels) >= most_levels:
                raise RuntimeError("the cascade does not end")
            rate = min(0.5, math.sqrt(0.5) * n / max(m, 1)) if not self.levels else 0.5
            bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
            if bits > most_bits:
                raise ValueError(f"a level of {bits} bits is over most_bits: split the rule list")
            hashes = max(1, round(math.log2(1 / rate)))
            self.levels.append((F.lit(self._filled(inside, bits, hashes)), bits, hashes))
            passed = saved(outside.where(self._passes(F.col("key"), len(self.levels))), "cascade-passed")
            inside, outside = passed, inside
            n, m = inside.count(), n

    def _filled(self, keys: DataFrame, bits: int, hashes: int) -> bytes:
        """The level's bits, gathered by 64-bit words: at most most_bits / 64 rows come to the driver."""
        level = len(self.levels) + 1
        spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits, hashes))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("word"))
        out = array("q", bytes(8 * -(-bits // 64)))
        for row in words.toLocalIterator():
            out[row["at"]] = row["word"]
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _passes(self, key: Column, level: int) -> Column:
        filled, bits, hashes = self.levels[level - 1]

        def test(spot: Column) -> Column:
            byte = F.substring(filled, F.shiftright(spot, 3).cast("int") + 1, F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (spot % 8).cast("int")) == 1

        out = F.lit(True)
        for spot in _spots(key, level, bits, hashes):
            out = out & test(spot)
        return out

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            out = F.when(~self._passes(key, level), F.lit(level % 2 == 0)).otherwise(out)
        return out


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each page."""
    spark: SparkSession = pages.sparkSession
    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    keys = keys_of(F.col("host"), F.col("path"), labels, lengths)
    names = spark.createDataFrame([(h + p, v) for v, h, p in rules], "key string, verdict string")
    listed = Cascade(names, parsed.select(F.explode(keys).alias("key")))
    blocked = Cascade(names.where("verdict = 'block'"), names)
    found = F.filter(keys, listed.contains)
    longest = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    out = parsed.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict)
