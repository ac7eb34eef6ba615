"""Logfmt text: key=value pairs with types, quoted values and bare words.

``parse_logfmt`` is built-in expressions; only the option of typed times, which
has forms of its own, takes the helper ``parse_text``.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields

PAIRS = "pairs map<string,struct<type:string,s:string,i:decimal(20,0),f:double>>, bare array<string>"
#: White space, then a quoted pair (which a missing quote ends at the text's end), a plain pair, or a bare word.
ITEM = re.compile(r'([^\s=]*)="((?:[^"\\]|\\.)*)(?:"|\\?\Z)|([^\s=]*)=(\S*)|([^\s=]+)', re.S)
#: The same item, and the inside of a quoted value, for the JVM. Possessive, so that no text is too long for it.
JVM_ITEM = r'(?sU)[^\s=]*="[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[^\s=]*=\S*|[^\s=]+'
JVM_QUOTED = r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)'
JVM_FLOAT = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
VALUE = "struct<type:string,s:string,i:decimal(20,0),f:double>"
FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)\Z", re.I | re.A)
UINT = re.compile(r"\+?\d+\Z", re.A)


def typed(value: str, typed_timestamps: bool = False) -> tuple:
    """(type, s, i, f) of a value: unsigned 64-bit integer, float, time or string."""
    from decimal import Decimal

    if UINT.match(value) and int(value) < 2**64:
        return "int", value, Decimal(int(value)), None
    if FLOAT.match(value):
        return "float", value, None, float(value)
    if typed_timestamps:
        for form in ("%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S"):
            try:
                return "timestamp", datetime.strptime(value, form).replace(tzinfo=timezone.utc).isoformat(), None, None
            except ValueError:
                continue
    return "string", value, None, None


def parse_text(text: str, typed_timestamps: bool = False) -> tuple[dict, list[str]]:
    pairs, bare = {}, []
    for m in ITEM.finditer(text):
        if m[5] is not None:
            bare.append(m[5])
            continue
        key, value = (m[1], re.sub(r"\\(.)", r"\1", m[2], flags=re.S)) if m[2] is not None else (m[3], m[4])
        pairs[key] = typed(value, typed_timestamps)
    return dict(sorted(pairs.items())), bare


def parse_logfmt(text: Column, typed_timestamps: bool = False) -> Column:
    """Struct of pairs (sorted by key; the last of repeated keys) and bare words; null for null."""
    if not typed_timestamps:
        return _with(F.regexp_extract_all(text, F.lit(JVM_ITEM), F.lit(0)), _parsed)

    @F.pandas_udf(PAIRS)
    def parse(texts: pd.Series) -> pd.DataFrame:
        done = [(None, None) if t is None else parse_text(t, typed_timestamps) for t in texts]
        return pd.DataFrame({"pairs": [None if p is None else {k: dict(zip(("type", "s", "i", "f"), v, strict=True)) for k, v in p.items()} for p, _ in done], "bare": [b for _, b in done]})

    return F.when(text.isNotNull(), parse(text))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once; null for null."""
    return F.get(F.transform(F.filter(F.array(value), lambda x: x.isNotNull()), use), F.lit(0))


def _typed_value(raw: Column) -> Column:
    """A value as it stands after the equals sign, with its type."""
    text = F.when(F.startswith(raw, F.lit('"')), F.regexp_replace(F.regexp_extract(raw, JVM_QUOTED, 1), r"(?s)\\(.)", "$1")).otherwise(raw)

    def typed(s: Column) -> Column:
        number = F.when(F.rlike(s, F.lit(r"^\+?[0-9]+$")), s.try_cast("decimal(20,0)"))
        number = F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)
        real = F.when(number.isNull() & F.rlike(s, F.lit(JVM_FLOAT)), s.try_cast("double"))
        kind = F.when(number.isNotNull(), "int").when(real.isNotNull(), "float").otherwise("string")
        return F.struct(kind.alias("type"), s.alias("s"), number.alias("i"), real.alias("f")).cast(VALUE)

    return _with(text, typed)


def _parsed(items: Column) -> Column:
    keyed = F.transform(F.filter(items, lambda x: F.contains(x, F.lit("="))), lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("key"), i.alias("i"), x.alias("item")))
    last = lambda s: F.filter(s, lambda x, i: (i + 1 == F.size(s)) | (F.get(s, i + 1)["key"] != x["key"]))
    value = lambda x: _typed_value(F.substring(x["item"], F.length(x["key"]) + 2, F.length(x["item"])))
    pairs = F.map_from_entries(F.transform(_with(F.array_sort(keyed), last), lambda x: F.struct(x["key"].alias("key"), value(x).alias("value"))))
    return F.struct(pairs.alias("pairs"), F.filter(items, lambda x: ~F.contains(x, F.lit("="))).alias("bare"))


def _string_of(parsed: Column, names: list[str]) -> Column:
    pair = lambda n: parsed["pairs"][n]
    return F.coalesce(*[F.when(pair(n)["type"] == "string", pair(n)["s"]) for n in names])


def logfmt_level(parsed: Column) -> Column:
    return F.coalesce(_string_of(parsed, fields.LOGFMT_LEVEL), F.lit("INFO"))


def logfmt_message(parsed: Column) -> Column:
    return F.coalesce(_string_of(parsed, fields.LOGFMT_MESSAGE), F.array_join(parsed["bare"], " "))


def drop_primary_keys(parsed: Column) -> Column:
    """Pairs without level, message and time."""
    return F.map_filter(parsed["pairs"], lambda k, v: ~k.isin(fields.LOGFMT_LEVEL + fields.LOGFMT_MESSAGE + fields.LOGFMT_TIME))
