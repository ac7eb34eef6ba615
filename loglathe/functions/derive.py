"""Display fields of records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields


def normalize_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up.isin("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL"), up).when(up == "WARNING", "WARN").when(up == "CRIT", "CRITICAL").when(level.isNotNull(), "INFO")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH:mm:ss")


def status_reason(status: Column) -> Column:
    """Known codes with their reason, others as they are."""
    code = F.when(F.rlike(status, F.lit(r"^\+?\d{1,9}$")), F.try_to_number(F.ltrim(status, F.lit("+")), F.lit("999999999")).cast("int"))
    out = status
    for number, reason in fields.REASONS.items():
        out = F.when(code == number, F.lit(f"{number} {reason}")).otherwise(out)
    return out


def request_line(method: Column, url: Column, status: Column, args: Column) -> Column:
    """``M U S``, ``US`` or ``S`` with the reason, then ``&args``; null if empty."""
    shown = F.coalesce(status_reason(status), F.lit(""))
    line = F.when(method.isNotNull() & url.isNotNull(), F.concat_ws(" ", method, url, shown)).when(url.isNotNull(), F.concat(url, shown)).otherwise(shown)
    return F.when(line != "", F.concat(line, F.coalesce(F.concat(F.lit("&"), args), F.lit(""))))


def path_args(request: Column, path: Column, args: Column) -> tuple[Column, Column]:
    """(path cell, args cell): the arguments go with the path only if there is no request line."""
    free = request.isNull()
    return F.when(free & args.isNotNull(), F.concat(path, F.lit("&"), args)).otherwise(path), F.when(path.isNull() & free, args)


def location(module: Column, function: Column, file: Column, line: Column) -> Column:
    """``module::function (file:line)``; a file alone ends with a bracket that nothing opens."""
    place = F.concat_ws("::", module, function)
    spot = F.concat(file, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")), F.lit(")"))
    out = F.concat(place, F.when(file.isNotNull() & (module.isNotNull() | function.isNotNull()), F.lit(" (")).otherwise(F.lit("")), F.coalesce(spot, F.lit("")))
    return F.when(module.isNotNull() | function.isNotNull() | file.isNotNull(), out)


def human_size(size: Column) -> Column:
    """Binary units with two decimals (half to even), none when whole."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"], 1):
        step = 1024**power
        whole = F.pmod(size, F.lit(step)) == 0
        text = F.when(whole, (size / F.lit(float(step))).cast("bigint").cast("string")).otherwise(F.format_string("%.2f", F.bround(size / F.lit(float(step)), 2)))
        out = F.when(size >= step, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def with_unit(value: Column, unit: str) -> Column:
    return F.concat(value, F.lit(unit))


def class_method(class_name: Column, method: Column) -> Column:
    return F.concat(class_name, F.lit(" :: "), method)


def time_column(ts: Column, request_id: Column, show_time: bool = True) -> Column:
    return F.coalesce(format_time(ts), request_id, F.lit("")) if show_time else F.lit("")


def visible_text(text: Column) -> Column:
    """Without ANSI colour escapes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def visible_width(text: Column) -> Column:
    return F.length(visible_text(text))


def base_name(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last != "", last).otherwise(F.lit("unknown"))


def is_multiline(text: Column) -> Column:
    return F.contains(text, F.lit("\n"))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)
