"""Scalar functions over source values, as column expressions (JVM side) but for the array parser."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PG_EPOCH_MICROS = 946_684_800_000_000  # 2000-01-01 in microseconds since 1970


def pg_bool(x: Column) -> Column:
    """t, true and 1 (any case) are true, all other text is false; null stays null."""
    return F.lower(x).isin("t", "true", "1")


def pg_number(x: Column, kind: str) -> Column:
    """A number, or null where the text isn't one; keep the text beside it."""
    return x.try_cast(kind)


def strip_money(x: Column, decimal_comma: bool | None = None) -> Column:
    """Digits, sign and point of a money text. With both signs commas group; a single kind of comma is the decimal point.

    decimal_comma=True reads 1.234,56 as 1234.56 and False reads commas as groups; None decides by the text alone."""
    kept = F.regexp_replace(x, "[^0-9.,-]", "")
    if decimal_comma is True:
        return F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if decimal_comma is False:
        return F.replace(kept, F.lit(","), F.lit(""))
    comma, point = F.contains(kept, F.lit(",")), F.contains(kept, F.lit("."))
    first = F.concat(F.substring_index(kept, ",", 1), F.lit("."), F.substring(kept, F.instr(kept, ",") + 1, F.length(kept)))
    return F.when(comma & point, F.replace(kept, F.lit(","), F.lit(""))).when(comma, first).otherwise(kept)


def normalize_tstz(x: Column) -> Column:
    """A timestamp with offset as UTC text; six digits of fraction only if the text has a fraction; other text stays."""
    ts = F.when(x.rlike(r"[+-]\d{2}(:?\d{2})?$") & x.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), x.try_cast("timestamp"))
    plain, fine = F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(F.when(F.contains(x, F.lit(".")), fine).otherwise(plain), x)


def micros_text(x: Column) -> Column:
    """Microseconds since 1970 as text with six digits of fraction; times before 1970 as well."""
    return F.date_format(F.timestamp_micros(x), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def epoch_text(x: Column) -> Column:
    """Seconds since 1970, as a number or as digits, as text."""
    return F.date_format(F.timestamp_seconds(x.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss")


def bytes_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def hex_bytes(x: Column) -> Column:
    return F.unhex(x)


def lsn_number(x: Column) -> Column:
    """hi/lo in hexadecimal as decimal(20,0): the top bit must not turn the number negative."""
    part = lambda k: F.conv(F.element_at(F.split(x, "/"), k), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(4294967296).cast("decimal(20,0)") + part(2)).cast("decimal(20,0)")


def lsn_text(x: Column) -> Column:
    step = F.lit(4294967296).cast("decimal(20,0)")
    low = (x % step).cast("bigint")
    return F.concat(F.hex(((x - (x % step)) / step).cast("bigint")), F.lit("/"), F.hex(low))


def lag_ms(commit_micros: Column, now_ms: Column) -> Column:
    """Milliseconds from a commit time (microseconds since 2000) to now; never negative."""
    return F.greatest(F.lit(0).cast("bigint"), now_ms - F.floor((commit_micros + F.lit(PG_EPOCH_MICROS)) / 1000).cast("bigint"))


def position_text(kind: Column, pos: Column, file: Column, gtid: Column) -> Column:
    """A position for people."""
    return (
        F.when(kind == "lsn", lsn_text(pos))
        .when(kind == "offset", pos.cast("string"))
        .when(kind == "file", F.concat_ws(":", file, pos.cast("string")))
        .when(kind == "gtid", gtid)
        .when(kind == "binlog", F.concat_ws(":", file, pos.cast("string"), F.when(gtid != "", gtid)))
    )


def position_ahead(kind_a: Column, a: Column, kind_b: Column, b: Column, file_a: Column | None = None, file_b: Column | None = None) -> Column:
    """Whether a is strictly ahead of b; null where the two can't be ordered (sets, mixed kinds)."""
    by_number = F.when((kind_a == kind_b) & kind_a.isin("lsn", "offset"), a > b)
    if file_a is None or file_b is None:
        return by_number
    in_files = (file_a > file_b) | ((file_a == file_b) & (a > b))
    return F.coalesce(by_number, F.when((kind_a == kind_b) & kind_a.isin("file", "binlog"), in_files))


def job_name(x: Column, upper: bool = False) -> Column:
    out = F.regexp_replace(x, "[^A-Za-z0-9]", "_")
    return F.upper(out) if upper else out


def version_at_least(x: Column, major: int, minor: int) -> Column:
    """Whether the first a.b in a version text is at least major.minor; null without one."""
    a = F.regexp_extract(x, r"(\d+)\.(\d+)", 1).try_cast("int")
    b = F.regexp_extract(x, r"(\d+)\.(\d+)", 2).try_cast("int")
    return (a > major) | ((a == major) & (b >= minor))


def has_property(ddl: Column, name: str, value: str) -> Column:
    """Whether a property list holds name = value or name : value, in any case and spacing."""
    return ddl.rlike(f'(?i)"?{name}"?\\s*[=:]\\s*"?{value}"?')


def image_json(columns: list[str], unchanged: Column | None = None) -> Column:
    """A row image as JSON with its nulls; columns named in `unchanged` are left out."""
    if unchanged is None:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    parts = [F.when(~F.coalesce(F.array_contains(unchanged, c), F.lit(False)), F.regexp_replace(F.to_json(F.struct(c), {"ignoreNullFields": "false"}), r"^\{|\}$", "")) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def parse_pg_array(text: str | None, kind: str = "text") -> str | None:
    """A one-dimensional array literal as a JSON array. Without braces: the text as a JSON string. Bare NULL is null."""
    if text is None:
        return None
    if not (text.startswith("{") and text.endswith("}")):
        return json.dumps(text, ensure_ascii=False)
    items: list[tuple[str, bool]] = []
    now, quoted, inside, escaped = [], False, False, False
    for c in text[1:-1]:
        if escaped:
            now.append(c)
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            inside, quoted = not inside, True
        elif c == "," and not inside:
            items.append(("".join(now), quoted))
            now, quoted = [], False
        else:
            now.append(c)
    if items or now or quoted:
        items.append(("".join(now), quoted))
    return "[" + ",".join(_element(t, q, kind) for t, q in items) + "]"


def _element(text: str, quoted: bool, kind: str) -> str:
    if not quoted and text.upper() == "NULL":
        return "null"
    try:
        if kind == "int":
            return str(int(text))
        if kind == "float" and abs(float(text)) < float("inf"):
            return json.dumps(float(text))
    except ValueError:
        pass
    return json.dumps(text, ensure_ascii=False)


def pg_array(kind: str = "text"):
    """parse_pg_array as a vectorized function of a column."""
    @F.pandas_udf("string")
    def parse(x: pd.Series) -> pd.Series:
        return x.map(lambda t: parse_pg_array(t, kind), na_action="ignore")

    return parse
