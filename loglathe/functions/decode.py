"""Strict decoding of log lines and their shapes, as column expressions.

A line is parsed once, to a VARIANT; everything else is taken from the parsed
value. ``decoded`` adds the helper columns, ``classified`` the shape, and the
``*_record`` functions the typed structs.

Each key of a line is looked up once: together with the type of its value it
stands for a set of bits (which fields of which shapes it fills, and whether it
breaks one), and the shapes are tests of these bits. The time is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fields
from .once import once

TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)$"
#: The forms that a cast reads as they are.
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"


def configure(spark: SparkSession) -> None:
    """Settings that the decoder relies on: the last of repeated keys wins, and times are UTC."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def strip_line_ending(line: Column) -> Column:
    """Without one carriage return at the end."""
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a text with an offset; seconds may be absent; null for all else."""
    out = F.translate(F.upper(text), ",", ".")
    # Each step names the one before once, so the expression stays small.
    for form, to in (
        (r"^(.{10}) ", "$1T"),
        (r"^(.{16})([Z+-])", "$1:00$2"),
        (r"(\.\d{6})\d+", "$1"),
        (r"(:\d{2}[.\d]*[+-]\d{2})(\d{2})$", "$1:$2"),
        (r"(:\d{2}[.\d]*[+-]\d{2})$", "$1:00"),
    ):
        out = F.regexp_replace(out, form, to)
    return F.when(F.rlike(text, F.lit(PLAIN_TIME)), text.try_cast("timestamp")).when(F.rlike(text, F.lit(TIME)), F.try_to_timestamp(out))


def nanos_of(text: Column) -> Column:
    """Digits seven to nine of the fraction, as a number from 0 to 999."""
    rest = F.when(F.length(text) > 27, F.regexp_extract(text, r"[.,]\d{6}(\d{1,3})", 1))
    return F.when(rest != "", F.rpad(rest, 3, "0").cast("int")).otherwise(F.lit(0))


def plain_number(text: Column) -> Column:
    """A number with an exponent (``1.5E-7``) in full, without a needless point."""
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.?(\d*)E([+-]?\d+)$", k)

    def placed(x: Column) -> Column:
        digits, point, size = x["digits"], x["point"], F.length(x["digits"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        large = F.concat(digits, F.repeat(F.lit("0"), point - size))
        between = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size))
        return F.concat(part(1), F.when(digits == "", "0").when(point <= 0, small).when(point >= size, large).otherwise(between))

    digits = F.regexp_replace(F.concat(part(2), part(3)), "0+$", "")
    full = _with(F.struct(digits.alias("digits"), (part(4).cast("int") + 1).alias("point")), placed)
    return F.when(F.contains(text, F.lit("E")), full).otherwise(F.regexp_replace(text, r"\.0$", ""))


def text_of_number(value: Column, kind: Column) -> Column:
    """A JSON number as text: shortest form, no exponent, no ``.0``."""
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind == "DOUBLE", plain_number(plain)).otherwise(plain)


def coerce_string_or_number(value: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(is_number(kind), text_of_number(value, kind))


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def is_uint(value: Column, kind: Column) -> Column:
    big = F.rlike(kind, F.lit(r"^DECIMAL\((19|20),0\)$"))
    return ((kind == "BIGINT") | big) & F.try_variant_get(value, "$", "decimal(20,0)").between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(20,0)"))


@once
def _envelope(line_col: str) -> Column:
    return F.concat(F.lit('{"v":'), F.col(line_col), F.lit(',"__end":1}'))


@once
def _value(line_col: str) -> Column:
    """The parsed value of a line; null if the line isn't JSON as a whole, or has a number beyond a double."""
    line, value = F.col(line_col), F.try_variant_get("__envelope", "$.v", "variant")
    whole = (F.size(F.json_object_keys(_envelope(line_col))) == 2) & (F.try_variant_get("__envelope", "$.__end", "int") == 1)
    infinite = r'"-?Infinity"'
    endless = F.rlike(line, F.lit(r"\d[eE]\+?\d{3}|\d{300}")) & F.rlike(F.to_json(value), F.lit(infinite)) & ~F.rlike(line, F.lit(infinite))
    fine = F.col("__envelope").isNotNull() & whole & ~F.coalesce(endless, F.lit(False))
    # through a generator, so that no filter above repeats the parsing
    return F.explode(F.array(F.when(fine, value)))


@once
def _keys_and_types(line_col: str) -> dict[str, Column]:
    keys = F.when(F.col("__map").isNotNull(), F.json_object_keys(line_col))
    return {"__keys": keys, "__types": F.transform_values("__map", lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))}


def decoded(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add __value (VARIANT, null if the line isn't JSON), __map (of an object), __keys (with repeats), __types.

    A number beyond the range of a double makes a line no JSON.
    """
    staged = lines.withColumn("__envelope", F.try_parse_json(_envelope(line_col)))
    staged = staged.withColumn("__value", _value(line_col)).drop("__envelope")
    return staged.withColumn("__map", F.try_variant_get("__value", "$", "map<string,variant>")).withColumns(_keys_and_types(line_col))


#: What a value can be: a string, a string with a time, a non-negative integer, another number, null, anything else.
CLASSES = ["text", "time", "uint", "number", "null", "other"]
#: Classes that a field's type takes.
TAKES = {"str": {"text", "time"}, "ts": {"time"}, "uint": {"uint"}, "strnum": {"text", "time", "uint", "number"}, "any": set(CLASSES)}
REQUIRED = {"canonical": fields.CANONICAL, "java": fields.JAVA, "time_only": fields.TIME_ONLY}


def _bit_plan() -> tuple[dict[str, dict[str, int]], dict[str, int], dict[str, int]]:
    """(bits of each key for each class of value, all bits of each shape's fields, each shape's bit of a known key)."""
    own, at = {}, 0
    for shape, table in [*REQUIRED.items(), ("message", fields.MESSAGE)]:
        for field in table:
            own[shape, field] = 1 << at
            at += 1
    known = {shape: 1 << at + k for k, shape in enumerate([*REQUIRED, "message", "broken"])}
    keys: dict[str, dict[str, int]] = {}
    for shape, table in REQUIRED.items():
        for field, (names, kind) in table.items():
            for name in names:
                bits = keys.setdefault(name, dict.fromkeys(CLASSES, 0))
                for c in CLASSES:
                    bits[c] |= known[shape] | (own[shape, field] if c in TAKES[kind] else 0)
    for field, (names, kind) in fields.MESSAGE.items():
        for name in names:
            bits = keys.setdefault(name, dict.fromkeys(CLASSES, 0))
            for c in CLASSES:
                fine = c in TAKES[kind] or c == "null" and field not in ("message", "level")
                bits[c] |= known["message"] | own["message", field] | (0 if fine else known["broken"])
    every = {shape: sum(own[shape, f] for f in table) for shape, table in [*REQUIRED.items(), ("message", fields.MESSAGE)]}
    return keys, every | {"message needs": own["message", "message"] | own["message", "level"]}, known


KEY_BITS, SHAPE_BITS, KNOWN_BITS = _bit_plan()


def _literal_map(entries: dict[str, str]) -> Column:
    """A map from plain names to SQL literals, as one expression: built piece by piece, it would cost seconds."""
    return F.expr(f"map({', '.join(f'{key!r}, {value}' for key, value in entries.items())})")


def _names(names) -> str:
    """A list of plain names for SQL's IN."""
    return ", ".join(map(repr, names))


def _entries(column: str, names) -> Column:
    """Entries of a map column under these names."""
    return F.expr(f"filter(map_entries({column}), e -> e.key IN ({_names(names)}))")


def _alias_map(table: dict) -> Column:
    return _literal_map({name: repr(field) for name, field in fields.aliases(table).items()})


def _codes(time: Column, other_time: Column) -> Column:
    """The bits of each known key of a line."""
    table = _literal_map({key: f"named_struct({', '.join(f'{c!r}, {bits[c]}L' for c in CLASSES)})" for key, bits in KEY_BITS.items()})
    times, others = fields.TIME_NAMES, [n for n in fields.MESSAGE["timestamp"][0] if n not in fields.TIME_NAMES]

    def code(e: Column) -> Column:
        key, kind = e["key"], e["value"]
        timed = key.isin(times) & time.isNotNull() | key.isin(others) & other_time.isNotNull()
        chosen = lambda b: (
            F.when(kind == "STRING", F.when(timed, b["time"]).otherwise(b["text"]))
            .when(is_number(kind), F.when(is_uint(F.col("__map")[key], kind), b["uint"]).otherwise(b["number"]))
            .when(kind == "VOID", b["null"])
            .otherwise(b["other"])
        )
        return _with(table[key], chosen)

    return F.transform(_entries("__types", KEY_BITS), code)


def _text_of(names: list[str]) -> Column:
    """The string under the first of these keys that is there."""
    found = F.coalesce(*[F.col("__map")[n] for n in names])
    kind = F.coalesce(*[F.col("__types")[n] for n in names])
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string"))


@once
def _times() -> tuple[dict[str, Column], dict[str, Column]]:
    """The texts of a line's times, and the times."""
    others = [n for n in fields.MESSAGE["timestamp"][0] if n not in fields.TIME_NAMES]
    texts = {"__time": _text_of(fields.TIME_NAMES), "__time_other": _text_of(others)}
    return texts, {"__ts": parse_rfc3339(F.col("__time")), "__ts_other": parse_rfc3339(F.col("__time_other"))}


@once
def _bits() -> tuple[Column, Column]:
    """The bits of each known key, and all of them together."""
    return _codes(F.col("__ts"), F.col("__ts_other")), F.aggregate("__codes", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


@once
def _shape() -> Column:
    bits, same = F.col("__bits"), F.size("__keys") == F.size("__map")
    has = lambda mask: bits.bitwiseAND(F.lit(mask)) == F.lit(mask)

    def known(shape: str) -> Column:
        """How many keys of the line, with repeats, the shape knows."""
        table = REQUIRED.get(shape, fields.MESSAGE)
        distinct = F.size(F.filter("__codes", lambda c: c.bitwiseAND(F.lit(KNOWN_BITS[shape])) != 0))
        return F.when(same, distinct).otherwise(F.expr(f"size(filter(__keys, k -> k IN ({_names(fields.names(table))})))"))

    required = lambda shape: has(SHAPE_BITS[shape]) & (known(shape) == len(REQUIRED[shape]))
    message = has(SHAPE_BITS["message needs"]) & (bits.bitwiseAND(F.lit(KNOWN_BITS["broken"])) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(SHAPE_BITS["message"]))) == known("message"))
    is_object = F.col("__map").isNotNull()
    shape = (
        F.when(F.col("__value").isNull(), F.lit("text"))
        .when(is_object, F.when(required("canonical"), "canonical").when(required("java"), "java").when(message, "message").when(required("time_only"), "time_only").otherwise("json"))
        .when(F.schema_of_variant("__value") == "STRING", F.lit("logfmt"))
        .otherwise(F.lit("text"))
    )
    return F.explode(F.array(shape))


def classified(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``shape`` to decoded lines (the first of the shapes that fits), and the parsed times __ts and __ts_other.

    The shape goes through a generator, so that filters on it and projections
    above are not merged with the tests below.
    """
    staged = lines if "__value" in lines.columns else decoded(lines, line_col)
    (texts, times), (codes, bits) = _times(), _bits()
    staged = staged.withColumns(texts).withColumns(times).withColumn("__codes", codes).withColumn("__bits", bits)
    return staged.withColumn("shape", _shape()).drop("__codes", "__bits")


def resolve_aliases(table: dict) -> Column:
    """Map of own field names to values of the keys that ``table`` knows; the later of two names wins."""
    alias = _alias_map(table)
    known = F.array_distinct(F.reverse(F.filter("__keys", lambda k: alias[k].isNotNull())))
    last = F.filter(known, lambda k, i: ~F.exists(F.slice(known, 1, i), lambda x: alias[x] == alias[k]))
    return F.map_from_entries(F.transform(last, lambda k: F.struct(alias[k].alias("key"), F.to_json(F.col("__map")[k]).alias("value"))))


def rest_map(table: dict) -> Column:
    """Keys that the shape doesn't know, sorted, with their values as JSON text."""
    known = fields.names(table)
    rest = F.expr(f"map_filter(__map, (k, v) -> k NOT IN ({_names(known)}))") if known else F.col("__map")
    return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(rest, lambda k, v: F.to_json(v)))))


def _typed(found: Column, field: str, kind: str) -> Column:
    """A field of the resolved keys (value and type by field name); integers keep all of 64 unsigned bits."""
    value, own = found["values"][field], found["types"][field]
    text = F.when(own == "STRING", F.try_variant_get(value, "$", "string"))
    return {
        "str": text,
        "ts": F.coalesce("__ts", "__ts_other"),
        "uint": F.when(is_uint(value, own), F.try_variant_get(value, "$", "decimal(20,0)")),
        "strnum": coerce_string_or_number(value, own),
        "any": F.to_json(value),
    }[kind]


def _record(shape: str, table: dict) -> Column:
    alias = _alias_map(table)
    named = lambda m: F.map_from_entries(F.transform(_entries(m, fields.names(table)), lambda e: F.struct(alias[e["key"]].alias("key"), e["value"].alias("value"))))
    found = F.struct(named("__map").alias("values"), named("__types").alias("types"))
    record = lambda x: F.struct(*[_typed(x, f, kind).alias(f) for f, (_, kind) in table.items()], rest_map(table).alias("rest"))
    return F.when(F.col("shape") == shape, _with(found, record))


@once
def canonical_record() -> Column:
    return _record("canonical", fields.CANONICAL)


@once
def java_record() -> Column:
    return _record("java", fields.JAVA)


@once
def message_record() -> Column:
    return _record("message", fields.MESSAGE)


@once
def time_only_record() -> Column:
    return _record("time_only", fields.TIME_ONLY)


@once
def json_record() -> Column:
    return F.when(F.col("shape") == "json", F.struct(rest_map({}).alias("rest")))


@once
def logfmt_text() -> Column:
    """Content of a logfmt line (a JSON string); null for other shapes."""
    return F.when(F.col("shape") == "logfmt", F.try_variant_get("__value", "$", "string"))


@once
def time_text() -> Column:
    """The text of a shape's time; null for shapes without one."""
    return F.when(F.col("shape") == "message", F.coalesce("__time", "__time_other")).when(F.col("shape").isin("canonical", "java", "time_only"), F.col("__time"))


@once
def _unified(line_col: str) -> dict[str, Column]:
    shape = F.col("shape")
    is_record, timed = shape.isin("canonical", "java", "message"), shape.isin("canonical", "java", "message", "time_only")
    ts = F.when(shape == "message", F.coalesce("__ts", "__ts_other")).when(timed, F.col("__ts"))
    return {
        "ts": ts,
        "ts_nanos": F.when(ts.isNotNull(), F.when(timed, nanos_of(time_text()))),
        "level": F.when(is_record, _text_of(fields.MESSAGE["level"][0])),
        "message": F.when(shape == "text", F.col(line_col)).when(is_record, _text_of(fields.MESSAGE["message"][0])),
    }


@once
def _unified_with_pairs(line_col: str, pairs: str) -> dict[str, Column]:
    from .logfmt import logfmt_level, logfmt_message

    columns, parsed = _unified(line_col), F.col(pairs)
    own = {"level": logfmt_level(parsed), "message": logfmt_message(parsed)}
    return columns | {k: F.when(F.col("shape") == "logfmt", v).otherwise(columns[k]) for k, v in own.items()}


def unified_record(parsed: DataFrame, line_col: str = "line", pairs: str | None = None) -> DataFrame:
    """Add ts, ts_nanos, level, message for any shape. ``pairs`` names the column of a parsed logfmt struct, if wanted."""
    return parsed.withColumns(_unified(line_col) if pairs is None else _unified_with_pairs(line_col, pairs))


def dropped(parsed: DataFrame) -> DataFrame:
    """Without the helper columns."""
    return parsed.drop("__value", "__map", "__keys", "__types", "__time", "__time_other", "__ts", "__ts_other")
