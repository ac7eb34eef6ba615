"""Plain-text rendering of records: cells and whole lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import derive


def value_text(value, top: bool = False) -> str:
    """A JSON value in display form: strings quoted, arrays flat, objects in braces."""
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, list):
        return ", ".join(map(value_text, value))
    if isinstance(value, dict):
        return "{ " + ", ".join(entry_text(k, v) for k, v in sorted(value.items())) + " }"
    return json.dumps(value)


def entry_text(key: str, value) -> str:
    return value_text(value) if isinstance(value, list) else f"{key}={value_text(value)}"


def render_nested(text: Column) -> Column:
    """Display form of JSON text, for arrays and objects; null for null."""

    @F.pandas_udf("string")
    def render(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else value_text(json.loads(v)))

    return render(text)


def render_value(text: Column) -> Column:
    """Display form of a value given as JSON text; only nested values and escapes reach the helper."""
    nested = F.rlike(text, F.lit(r'^[\[{]|\\'))
    return F.when(nested, render_nested(F.when(nested, text))).otherwise(text)


def render_entry(key: Column, text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("[")), render_value(text)).otherwise(F.concat(key, F.lit("="), render_value(text)))


def quoted(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{key}="'), value.cast("string"), F.lit('"'))


def rest_cells(rest: Column) -> Column:
    """Cells of flat values of a rest map, in key order; nested ones in JSON form."""
    return F.transform(F.map_entries(rest), lambda e: F.when(F.startswith(e["value"], F.lit("[")), e["value"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))


def nested_rest_cells(rest: Column) -> Column:
    """Cells of a rest map in display form, nested values included."""

    @F.pandas_udf("array<string>")
    def render(maps: pd.Series) -> pd.Series:
        return maps.map(lambda m: None if m is None else [entry_text(k, json.loads(v)) for k, v in sorted(dict(m).items())])

    has_nested = F.exists(F.map_values(rest), lambda v: F.rlike(v, F.lit(r'^[\[{]|\\')))
    return F.when(has_nested, render(F.when(has_nested, rest))).otherwise(rest_cells(rest))


def canonical_cells(r: Column) -> Column:
    own = [quoted("reqid", r["request_id"]), quoted("method", r["method"]), quoted("url", r["url"]), F.concat(F.lit("status="), r["status"].cast("string")), quoted("size", derive.human_size(r["size"])), quoted("elapsed", r["elapsed"]), quoted("remote_host", r["remote_host"]), quoted("user_agent", r["user_agent"])]
    return F.concat(F.array(*own), nested_rest_cells(r["rest"]))


def java_cells(r: Column) -> Column:
    own = [quoted("reqid", derive.non_empty(r["request_id"])), quoted("thread", derive.non_empty(r["thread"])), quoted("class", derive.class_method(r["class"], r["method"])), quoted("source", r["source"])]
    return F.concat(F.array_compact(F.array(*own)), nested_rest_cells(r["rest"]))


def message_cells(r: Column, show_time: bool = True) -> Column:
    request = derive.request_line(r["method"], r["url"], r["status"], r["query_args"])
    path, args = derive.path_args(request, r["path"], r["query_args"])
    own = [
        quoted("location", derive.location(r["module"], r["function"], r["file"], r["line"])),
        F.lit(None).cast("string") if show_time else quoted("reqid", r["request_id"]),
        quoted("request", request),
        quoted("path", path),
        quoted("args", args),
        quoted("request_size", derive.with_unit(r["request_size"], " bytes")),
        *[quoted(n, r[n]) for n in ("log", "stream", "pod", "namespace", "container", "node", "response_bytes")],
        quoted("request_time", r["request_duration"]),
        quoted("upstream_time", r["upstream_time"]),
        quoted("upstream", r["upstream_server"]),
        quoted("upstream_status", r["upstream_status"]),
        quoted("upstream_header_time", derive.with_unit(r["upstream_header_time"], "ms")),
        *[quoted(n, r[n]) for n in ("trace_id", "span_id", "trace_flags")],
        render_value(r["resource"]),
        *[quoted(n, r[n]) for n in ("thread", "host", "user_agent", "elapsed", "size")],
    ]
    return F.concat(F.array_compact(F.array(*own)), nested_rest_cells(r["rest"]))


def logfmt_cells(parsed: Column) -> Column:
    from .logfmt import drop_primary_keys

    shown = F.transform(F.map_entries(drop_primary_keys(parsed)), lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"]["type"] == "int", e["value"]["i"].cast("string")).otherwise(e["value"]["s"])))
    return F.concat(shown, parsed["bare"])


def render_record(shape: Column, level: Column, time: Column, message: Column, cells: Column, line: Column, trace: Column | None = None) -> Column:
    """Level (8, right), time (20, left), message lines, then the cells and a Java trace; text lines as they are."""
    bar = " │ "
    pad = "\n" + " " * 29 + bar
    name = F.when(shape.isin("time_only", "json"), F.lit("JSON")).otherwise(F.coalesce(derive.normalize_level(level), F.lit("INFO")))
    head = F.concat(F.lpad(name, 8, " "), F.lit(" "), F.rpad(F.coalesce(time, F.lit("")), 20, " "), F.lit(bar))
    body = F.replace(F.coalesce(message, F.lit("")), F.lit("\n"), F.lit(pad))
    shown = F.when(F.size(cells) > 0, F.array_join(cells, "  "))
    parts = [F.when(shape.isin("time_only", "json"), F.concat(head, F.coalesce(shown, F.lit("")))).otherwise(F.concat(head, body, F.coalesce(F.concat(F.lit(pad), shown), F.lit(""))))]
    if trace is not None:
        parts.append(F.coalesce(F.concat(F.lit(pad), F.replace(derive.non_empty(trace), F.lit("\n"), F.lit(pad))), F.lit("")))
    return F.when(shape == "text", line).otherwise(F.concat(*parts))
