"""Rendering, coercion, event time, token estimates: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render_double(x: Column) -> Column:
    """A double as text: shortest digits, exponent form from 1e6 up and below 1e-4, no trailing `.0`."""
    s = F.abs(x).cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    mantissa, exponent = F.regexp_extract(s, r"^([0-9.]+)", 1), F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    plain = F.regexp_replace(mantissa, r"\.0$", "")
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "0+$", "")
    million = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.expr("''"), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e+06"))
    size = F.abs(x)
    body = (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "+Inf").otherwise("Inf"))
        .when((size >= 1e6) & (size < 1e7), million)
        .when((size >= 1e-4) & (size < 1e-3), F.concat(F.lit("0.000"), digits))
        .when(s.contains("E"), F.concat(plain, power))
        .otherwise(plain)
    )
    return F.concat(sign, body)


def render(col: Column, kind: T.DataType | None = None) -> Column:
    """A value as text: null or absent is empty, strings as they are, the rest in plain form."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = render_double(col.cast("double"))
    elif isinstance(kind, T.ArrayType):
        inner = lambda x: render(x, kind.elementType)
        out = F.concat(F.lit("["), F.array_join(F.transform(col, inner), " "), F.lit("]"))
    else:
        out = col.cast("string")
    return F.coalesce(out, F.lit(""))


def as_number(col: Column) -> Column:
    """Tolerant number: null where it is none."""
    return F.expr("double(null)") if col is None else col.try_cast("double")


def as_strings(col: Column, kind: T.DataType) -> Column:
    """Tolerant list of strings: a list as it is, a comma-separated text split and trimmed, a scalar alone; blanks go."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(col, lambda x: render(x, kind.elementType))
    elif isinstance(kind, T.StringType):
        items = F.split(col, ",")
    else:
        items = F.array(render(col, kind))
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def event_time(col: Column, kind: T.DataType) -> Column:
    """Timestamps, RFC 3339 or `YYYY-MM-DD HH:MM:SS` texts, epoch numbers in s, ms, us or ns by magnitude; zero and the rest null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if isinstance(kind, T.StringType):
        shape = col.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$")
        return F.when(shape, col.try_cast("timestamp"))
    n = col.cast("decimal(38,6)")
    micros = F.when(F.abs(n) >= 1e17, n / 1000).when(F.abs(n) >= 1e14, n).when(F.abs(n) >= 1e11, n * 1000).otherwise(n * 1000000)
    return F.when(n != 0, F.timestamp_micros(micros.cast("bigint")))


def ingestion_time(col: Column) -> Column:
    """An event time, or now where there is none."""
    return F.coalesce(col, F.current_timestamp())


def estimate_tokens(text: Column) -> Column:
    """Bytes div 4, plus 1."""
    return F.floor(F.octet_length(text) / 4).cast("bigint") + 1


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stable_id(prefix: str, *cols: Column) -> Column:
    """An id from content, the same in every run."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *cols).cast("binary"), 256), 1, 16))
