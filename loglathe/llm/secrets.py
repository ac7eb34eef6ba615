"""Secret scan: known forms, and stretches of high Shannon entropy.

Known forms (``BASE``) are taken by regular expressions, leftmost and without
overlap for each kind. Beside them, candidates are the longest runs of one
character class (``CLASSES``) that fill a window; over each candidate a window
slides one character at a time, and the counts of the characters in it change
by one that enters and one that leaves. With f(c) = c log2 c, the entropy of a
window of w characters is log2 w - sum f(count) / w, so the sum is all that is
kept, in whole numbers (scaled by 2^20): it doesn't drift, and a window counts
if the sum is small enough. Windows that count and touch are one span. A span
needs a letter and a digit; a candidate that fits the allow-list gives none.
Spans of different kinds may overlap. Long candidates are taken in stretches
of ``STRETCH`` windows, so no array is copied for each character.

Only DataFrame functions are used, no row meets another, and nothing is
shuffled. Positions are code points, ends are exclusive.

Defined results: null and empty texts have no spans; texts and candidates of any
length are scanned whole; repeated rows have equal results; null ids are kept;
spans with one start come in the order of ``KINDS``; an empty table gives an
empty result; other columns are kept, but one named ``spans`` is replaced.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that is measured, its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Kind, pattern of a character, the characters that are told apart (in lower case, if none is upper), window, least entropy in bits a character.
CLASSES = {
    "entropy_base64": ("[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.9),
    "entropy_hex": ("[A-Fa-f0-9]", "0123456789abcdef", 20, 3.0),
}
KINDS = [*BASE, *CLASSES]
#: Candidates that hold one of these are no secrets: UUIDs, digests of integrity attributes, alphabets, placeholders.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^sha(1|256|384|512)-",
    r"(?i)abcdefgh|01234567|12345678",
    r"(?i)example|placeholder|x{6}",
)
#: Known forms start with one of these; looked at first, it spares most of the alternatives.
STARTS = {"assign": "(?=[PSTApsta])"}
SCALE = 1 << 20
STRETCH = 256
BLOCK = 512


def weights(window: int) -> list[int]:
    """c log2 c in whole numbers, for counts from 0 to the window."""
    return [0] + [round(c * log2(c) * SCALE) for c in range(1, window + 1)]


def most_weight(window: int, entropy: float) -> int:
    return floor((log2(window) - entropy) * window * SCALE)


def running(sizes: Column) -> Column:
    """Running totals of an array of long; in blocks, since an array that grows is copied each time."""
    grown = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), empty, grown))
    moved = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<long>>").alias("all")),
        lambda a, b: F.struct((a["sum"] + b["sum"]).alias("sum"), F.concat(a["all"], F.array(F.transform(b["all"], lambda x: x + a["sum"]))).alias("all")),
    )
    return F.when(F.size(sizes) > 0, F.flatten(moved["all"])).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap: array of (start, end, piece)."""
    return _placed(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps")))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(taken: Column) -> Column:
    none = F.array().cast("array<struct<start:long,end:long,piece:string>>")

    def put(x: Column) -> Column:
        steps = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        return F.zip_with(x["found"], running(steps), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("piece")))

    return _with(taken, lambda x: F.when(F.size(x["found"]) == 0, none).otherwise(put(x)))


def base_spans(text: Column, kind: str) -> Column:
    """Matches of a known form that are long enough."""
    pattern, group, least = BASE[kind]
    measured = (lambda m: m["piece"]) if not group else (lambda m: F.regexp_extract(m["piece"], pattern, group))
    return F.filter(matches(text, STARTS.get(kind, "") + pattern), lambda m: F.length(measured(m)) >= least)


def _tense(candidate: Column, first: Column, symbols: str, window: int, limit: int) -> Column:
    """Spans of one stretch of windows: array of (start, end), relative to the candidate."""
    table = F.array(*[F.lit(w).cast("long") for w in weights(window)])
    stretch = F.substring(candidate, first + 1, F.lit(STRETCH + window - 1))
    stretch = F.lower(stretch) if symbols == symbols.lower() else stretch
    codes = F.transform(F.split(stretch, ""), lambda c: F.instr(F.lit(symbols), c) - 1)
    start = F.struct(
        F.array_repeat(F.lit(0), len(symbols)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )

    def slide(state: Column, step: Column) -> Column:
        enters, leaves, at = step["enters"], step["leaves"], step["at"]
        gone = F.coalesce(F.get(state["counts"], leaves), F.lit(0))
        there = F.get(state["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
        minus = F.when(leaves >= 0, F.get(table, gone - 1) - F.get(table, gone)).otherwise(F.lit(0).cast("long"))
        total = state["sum"] + minus + F.get(table, there + 1) - F.get(table, there)
        counts = F.transform(state["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        begin = (first + at - window + 1).cast("long")
        new = F.struct(begin.alias("start"), (begin + window).alias("end"))
        n = F.size(state["spans"])
        last = F.get(state["spans"], n - 1)
        longer = F.concat(F.slice(state["spans"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), new["end"].alias("end"))))
        grown = F.when((n > 0) & (last["end"] >= begin), longer).otherwise(F.concat(state["spans"], F.array(new)))
        spans = F.when((at >= window - 1) & (total <= limit), grown).otherwise(state["spans"])
        return F.struct(counts.alias("counts"), total.alias("sum"), spans.alias("spans"))

    steps = _with(codes, lambda k: F.transform(k, lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(k, i - window)).otherwise(F.lit(-1)).alias("leaves"), i.alias("at"))))
    return F.aggregate(steps, start, slide, lambda s: s["spans"])


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch made one."""

    def add(a: Column, x: Column) -> Column:
        n = F.size(a)
        last = F.get(a, n - 1)
        longer = F.concat(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((n > 0) & (last["end"] >= x["start"]), longer).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), add)


def tense_spans(text: Column, kind: str, allow: tuple[str, ...] = ALLOW, allowed: tuple[str, ...] = ()) -> Column:
    """Spans of high entropy in the candidates of a class: array of (start, end, piece)."""
    one, symbols, window, entropy = CLASSES[kind]
    limit, pattern = most_weight(window, entropy), f"{one}{{{window},}}"
    distinct = 2**entropy  # fewer different characters can't reach the entropy

    def mixed(c: Column) -> Column:
        return F.rlike(c["piece"], F.lit("[0-9]")) & F.rlike(c["piece"], F.lit("[A-Za-z]"))

    def wanted(c: Column) -> Column:
        ok = mixed(c)
        for form in allow:
            ok = ok & ~F.rlike(c["piece"], F.lit(form))
        if allowed:
            ok = ok & ~c["piece"].isin(*allowed)
        return ok & (F.size(F.array_distinct(F.split(c["piece"], ""))) >= distinct)

    def spans(c: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor((F.length(c["piece"]) - window) / STRETCH).cast("int"))
        found = _joined(F.flatten(F.transform(stretches, lambda s: _tense(c["piece"], s * STRETCH, symbols, window, limit))))
        pieces = F.transform(found, lambda s: F.struct((c["start"] + s["start"]).alias("start"), (c["start"] + s["end"]).alias("end"), F.substring(c["piece"], s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).alias("piece")))
        return F.filter(pieces, mixed)

    return F.flatten(F.transform(F.filter(matches(text, pattern), wanted), spans))


def scanned(docs: DataFrame, allow: tuple[str, ...] = ALLOW, allowed: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``spans``: array of (start, end, rank, kind, piece), rank being the place of kind in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ranked = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["piece"].alias("piece")))
    base = F.concat(*[ranked(base_spans(text, kind), kind) for kind in BASE])
    more = F.concat(*[ranked(tense_spans(text, kind, allow, allowed), kind) for kind in CLASSES])
    return docs.withColumn("spans", F.array_sort(F.concat(base, more)))


def shown(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of spans, joined by commas."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans of each known form, digest of those, all spans as text."""
    found = scanned(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(shown(F.col("spans"), list(BASE)), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
