"""MinHash near-duplicates with odd sketches.

A text's set is its distinct word shingles. Equal sets fall together first, by a
128-bit digest. Each distinct set gets ``bands * rows`` MinHash samples; bands
of them give buckets, and the samples folded into a parity bitmap give an odd
sketch, whose XOR population count estimates high similarities. Instead of all
pairs of a bucket, its members are paired with its smallest id, the hub. Pairs
that the sketches rule out (far below the threshold) go, all others are
confirmed on full sets. Links give components.

Members of one hub's group that are still in different components may be linked
with each other too. Their sketches alone are compared, in blocks of thousands;
texts that no sketch of another component comes near are done. For the others, a
link at the threshold needs a common shingle among each set's rarest ones (as
many as the threshold lets two sets differ by, and one more); texts that share
none of these with a text of another component are done too. The full sets of
the rest are compared in blocks of bounded size, and each block returns no more
links than it takes to join its components: no bucket is capped, no pair that
can be linked is left out, and no group is expanded into pairs.

Defined results: texts without words are linked with nothing; texts with fewer
words than a shingle have their whole sequence as one; texts of any length have
all their shingles; rows with a null id have no component and are kept; rows
with one id are one node, and links of any of its texts count; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, partitions, saved, small_batches, small_side

BANDS, ROWS, SKETCH_BITS, COUNT_BITS = 36, 5, 512, 20
_MIX, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z are lower-cased, ASCII white space cuts."""
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "replace").lower().split() if text else []
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mixed(out * _STEP + h[j : j + len(out)])
    return np.unique(out)


def _samples(shingles: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples; each is the least of a keyed multiple of the hashes."""
    keys = _mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(count, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(shingles[at : at + 2048], keys).min(axis=0), out=least)
    return least


def signature(shingles: np.ndarray, bands: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, odd sketch), both as signed 64-bit integers."""
    least = _samples(shingles, bands * rows)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = _mixed(keys * _STEP + column)
    spots = _mixed(least + np.arange(len(least), dtype=np.uint64) * _MIX) % np.uint64(bits)
    parity = (np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(parity).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bands, sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                d = xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                digests.append((d >> 64, d & (2**64 - 1)))
                k, o = signature(s, bands, rows, bits) if len(s) else (None, None)
                keys.append(k)
                sketches.append(o)
            digests = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, longs), pa.array(sketches, longs)], names=["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>, sketch array<long>")


def sets_of(docs: DataFrame, texts: DataFrame, words: int, most_broadcast_rows: int, used: list[str]) -> DataFrame:
    """(id, d1, set): sorted hashes, one row for each of ``texts`` (columns ``id`` and ``d1``, distinct)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            own = [shingle_set(x.as_py(), words) for x in batch.column(1)]
            high = np.array([xxh3_128_intdigest(x.tobytes()) >> 64 for x in own], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(high), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["id", "d1", "set"])

    ids = texts.select("id").distinct()
    wanted = docs.select("doc_id", "text").join(small_side(ids, ids.count(), most_broadcast_rows), F.col("doc_id") == F.col("id"), "left_semi")
    return saved(wanted.mapInArrow(pack, f"id {kind}, d1 long, set array<long>").dropDuplicates(["id", "d1"]), "shingle-sets", used)


def most_odd(similarity: float, samples: int, bits: int) -> int:
    """Odd bits expected of two sketches at this similarity."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def odd_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for each id of ``links`` (a, b), by alternating stars.

    The least neighbours are written before they are joined, so that adaptive
    execution can split the rows of a node with very many links.
    """
    spark, state, old = links.sparkSession, None, []
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", old)
    for _ in range(most_rounds):
        used, old = old, []
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", used)
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars", used)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        forget(spark, *used)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _similar(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    low, high = sorted((len(a), len(b)))
    if low * share.denominator < high * share.numerator:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return share.denominator * common >= share.numerator * (len(a) + len(b) - common)


def _joining(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[int]:
    """The links (a, b) that join components ca and cb not joined by the ones before."""
    parent: dict = {}

    def root(x):
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    out = []
    for k, (x, y) in enumerate(zip(ca.tolist(), cb.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def block_links(pdf: pd.DataFrame, share: Fraction) -> pd.DataFrame:
    """Links between members of different components, no more than join them."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    own = [np.asarray(x).view(np.uint64) for x in pdf["set"]]
    size = np.array([len(x) for x in own])
    shingles, member = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    _, column, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    member, column = member[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(own), len(own)), np.float32)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    step = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        has = np.zeros((len(own), step), np.float32)
        has[member[a:b], column[a:b] - first] = 1
        common += has @ has.T
    common = np.rint(common).astype(np.int64)
    linked = share.denominator * common >= share.numerator * (size[:, None] + size[None, :] - common)
    comp, block = pdf["component"].to_numpy(), pdf["block"].to_numpy()
    linked &= comp[:, None] < comp[None, :]
    if len(set(block)) > 1:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(linked)
    few = _joining(i, j, comp[i], comp[j])
    return pd.DataFrame({"a": pdf["id"].to_numpy()[i[few]], "b": pdf["id"].to_numpy()[j[few]]})


def block_near(pdf: pd.DataFrame, share: float, most: int) -> pd.DataFrame:
    """Members that a member of another component comes near: by set size, and at most ``most`` odd bits of the sketches."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    bits = np.unpackbits(np.array(pdf["sketch"].tolist(), np.int64).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    size, comp, block = pdf["n"].to_numpy(), pd.factorize(pdf["component"])[0], pdf["block"].to_numpy()
    other = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0  # where the second block begins
    near = np.zeros(len(pdf), bool)
    for first in range(0, other or len(pdf), 1024):
        rows = slice(first, min(first + 1024, other or len(pdf)))
        odd = (bits.shape[1] - bits[rows] @ bits[other:].T) / 2
        ok = (odd <= most) & (comp[rows, None] != comp[None, other:])
        a, b = size[rows, None], size[None, other:]
        ok &= np.minimum(a, b) >= share * np.maximum(a, b) - 1e-9
        near[rows] |= ok.any(axis=1)
        near[other:] |= ok.any(axis=0)
    return pdf.loc[near, ["id", "d1"]]


def in_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """Members of each group dealt into blocks of about ``block``, one row for each pair of blocks: i, j, block (its own)."""
    count = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumns({"__count": count, "block": F.pmod(F.xxhash64("id", "d1"), count).cast("int")})
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    return dealt.withColumns({"i": F.least("block", "__other"), "j": F.greatest("block", "__other")}).drop("__count", "__other", "size")


def shingle_counts(sets: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """How often shingles of each of ``2**bits`` hash ranges occur: a table of fixed size, gathered from each task's own."""

    def count(batches):
        own = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(own, (x.values.to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1)
        at = np.nonzero(own)[0]
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(own[at])], names=["at", "n"])

    got = sets.select("set").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def sharing(members: DataFrame, sets: DataFrame, share: Fraction, used: list[str]) -> DataFrame:
    """(id, d1) of members that share one of their rarest shingles with one of another component's members.

    Two sets of similarity ``share`` or more have a common one among the first
    n - ceil(share * n) + 1 in any order that holds for all sets; here by the
    count of the shingle's hash range, then by the shingle.
    """
    shared = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))  # of fixed size
    kind = sets.schema["id"].dataType.simpleString()

    def rarest(batches):
        counts = shared.value
        for batch in batches:
            own = [x.values.to_numpy().view(np.uint64) for x in batch.column("set")]
            first = []
            for x in own:
                often = counts[(x >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                k = len(x) - -(-len(x) * share.numerator // share.denominator) + 1
                at = np.lexsort((x, often))[:k]
                first.append(x[at[often[at] > 1]].view(np.int64))
            row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in first]))
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(flat), *[batch.column(c).take(row) for c in ("id", "d1", "component")]], names=["t", "id", "d1", "component"])

    known = sets.join(members.hint("merge"), ["id", "d1"]).select("id", "d1", "component", "set")
    rare = saved(known.mapInArrow(rarest, f"t long, id {kind}, d1 long, component {kind}"), "rare-shingles", used)
    across = rare.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("t")
    return saved(rare.join(across, "t").select("id", "d1").distinct(), "sharing-members", used)


def linked(docs: DataFrame, words: int = 5, similarity: str = "0.8", bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, block: int = 512, sketch_block: int = 4096, most_broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``."""
    spark, share = docs.sparkSession, Fraction(similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    used: list[str] = []  # tables that the result doesn't read
    signed = saved(signatures(docs, words, bands, rows, bits), "signatures")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Copies have equal samples; partial sums keep one row of a set for each task.
    reps = saved(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "set-classes")

    member = reps.select("rep", "d1", F.explode("bands").alias("h"))
    hub = F.min(F.struct("rep", "d1"))
    buckets = saved(member.groupBy("h").agg(hub.alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("h", F.col("hub.rep").alias("hub"), F.col("hub.d1").alias("hub_d1")), "buckets", used)
    pairs = saved(member.join(buckets, "h").where("rep <> hub").select("hub", "hub_d1", "rep", "d1").distinct(), "hub-pairs", used)

    sketch = reps.select("rep", "d1", "sketch")
    one = sketch.select("rep", "d1", F.col("sketch").alias("s1"))
    two = sketch.select(F.col("rep").alias("hub"), F.col("d1").alias("hub_d1"), F.col("sketch").alias("s2"))
    # Six standard deviations below the threshold, the estimate rules a pair out.
    far = float(share) - 6 * math.sqrt(float(share * (1 - share)) / (bands * rows) * 1.6)
    most = most_odd(far, bands * rows, bits)
    near = pairs.join(one, ["rep", "d1"]).join(two, ["hub", "hub_d1"]).where(odd_bits(F.col("s1"), F.col("s2")) <= most)
    near = saved(near.select("hub", "hub_d1", "rep", "d1"), "near-pairs", used)
    texts = near.select(F.explode(F.array(F.struct(F.col("hub").alias("id"), F.col("hub_d1").alias("d1")), F.struct(F.col("rep").alias("id"), "d1"))).alias("x")).select("x.*").distinct()
    sets = sets_of(docs, texts, words, most_broadcast_rows, used)

    @F.arrow_udf("boolean")
    def confirmed(a: pa.Array, b: pa.Array) -> pa.Array:
        views = [[x.values.to_numpy().view(np.uint64) for x in side] for side in (a, b)]
        return pa.array([_similar(x, y, share) for x, y in zip(*views, strict=True)], pa.bool_())

    one = sets.select(F.col("id").alias("rep"), "d1", F.col("set").alias("x"))
    two = sets.select(F.col("id").alias("hub"), F.col("d1").alias("hub_d1"), F.col("set").alias("y"))
    with_sets = near.join(one, ["rep", "d1"]).join(two, ["hub", "hub_d1"])
    links = saved(with_sets.where(confirmed("x", "y")).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "confirmed-links")
    found = components(links)

    # Groups of a hub in which texts other than the hub may still be linked across components.
    group = pairs.select("hub", "rep", "d1").unionByName(pairs.select("hub", F.col("hub").alias("rep"), F.col("hub_d1").alias("d1")).distinct())
    group = group.join(found, group["rep"] == found["id"], "left").select("hub", "rep", "d1", F.coalesce("component", "rep").alias("component"))
    sizes = group.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = saved(sizes.where("size > 2 AND low <> high").select("hub", "size"), "open-groups", used)
    rest = saved(group.join(open_, "hub"), "open-members", used)
    # A text's main group is its largest; a group whose texts all share another main group adds nothing.
    main = saved(rest.groupBy("rep", "d1").agg(F.max(F.struct("size", "hub"))["hub"].alias("main")), "main-groups", used)
    needed = rest.join(main, ["rep", "d1"]).groupBy("hub").agg(F.min("main").alias("low"), F.max("main").alias("high")).where("low <> high OR low = hub").select("hub")
    needed = saved(needed, "needed-groups", used)
    rest = saved(rest.join(needed, "hub", "left_semi").withColumnRenamed("rep", "id"), "group-members", used)
    if not rest.isEmpty():
        deal = lambda df: df.repartition(partitions(spark), "group", "i", "j").groupBy("group", "i", "j")
        facts = reps.select(F.col("rep").alias("id"), "d1", "n", "sketch")
        dealt = in_blocks(rest.withColumnRenamed("hub", "group"), "group", sketch_block).join(facts, ["id", "d1"])
        close = deal(dealt).applyInPandas(lambda pdf: block_near(pdf, float(share), most), f"id {kind}, d1 long").distinct()
        close = saved(close.join(rest.select("id", "d1", "component").distinct(), ["id", "d1"]), "near-members", used)
        if not close.isEmpty():
            sets = sets_of(docs, close, words, most_broadcast_rows, used)
            left = rest.join(sharing(close, sets, share, used), ["id", "d1"], "left_semi").drop("size")
            left = saved(left, "sharing-groups", used)
            sizes = left.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub", "size")
            dealt = in_blocks(left.join(sizes, "hub").withColumnRenamed("hub", "group"), "group", block)
            more = deal(dealt.join(sets, ["id", "d1"])).applyInPandas(lambda pdf: block_links(pdf, share), f"a {kind}, b {kind}")
            more = saved(more, "block-links", used)
            if not more.isEmpty():
                found = components(links.unionByName(more))

    classes = reps.select("d1", "d2", "rep").join(found, F.col("rep") == found["id"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    classes = saved(classes, "classes")
    forget(spark, *used)
    out = signed.select("doc_id", "n", "d1", "d2")
    alone = out.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    joined = out.where("n > 0 AND doc_id IS NOT NULL").join(classes.hint("merge"), ["d1", "d2"]).select("doc_id", "n", "component_id")
    every = joined.unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
