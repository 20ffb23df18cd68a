"""Values as text, and the Turkish spellings of numbers, sizes and durations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(value, true: str = "true", false: str = "false") -> str:
    """None is empty, booleans by name, lists and objects as JSON, the rest as it prints."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return true if value else false
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def json_as_text(value: Column, legacy: bool = False) -> Column:
    """Text of a JSON value in Spark's spelling of nested values."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    flag = F.try_variant_get(v, "$", "boolean")
    names = ("True", "False") if legacy else ("true", "false")
    return (
        F.when(v.isNull() | (kind == "VOID"), "")
        .when(kind == "BOOLEAN", F.when(flag, names[0]).otherwise(names[1]))
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    )


@F.pandas_udf(T.StringType())
def json_as_text_exact(value: pd.Series) -> pd.Series:
    """The same with ``", "`` and ``": "`` between the parts of nested values."""
    def one(s):
        try:
            return "" if s is None else as_text(json.loads(s))
        except ValueError:
            return s

    return value.map(one)


def grouped(n: Column) -> Column:
    """A whole number in groups of three between points; null as a dash."""
    return F.coalesce(F.translate(F.format_number(n.cast("decimal(38,0)"), 0), ",", "."), F.lit("-"))


def byte_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit that fits: 1536 as 1,5 KB."""
    x, units = n.cast("double"), ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.when(n.isNull(), "-").when(F.abs(x) < 1024, F.concat(x.cast("long").cast("string"), F.lit(" B")))
    for i, u in enumerate(units[1:], 1):
        s = F.concat(F.translate(F.format_string("%.1f", x / float(1024**i)), ".", ","), F.lit(f" {u}"))
        out = out.when(F.abs(x) < float(1024 ** (i + 1)), s) if u != "PB" else out.otherwise(s)
    return out


def duration(seconds: Column) -> Column:
    """Seconds as milliseconds, seconds, minutes or hours: 0.25 as 250,0 ms, 75 as 1 dk 15 sn."""
    s, whole = seconds.cast("double"), F.floor(seconds).cast("long")
    comma = lambda f, x: F.translate(F.format_string(f, x), ".", ",")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, hours = F.floor(whole / 60).cast("long"), F.floor(whole / 3600).cast("long")
    return (
        F.when(s.isNull(), "-").when(s < 1, F.concat(comma("%.1f", s * 1000), F.lit(" ms")))
        .when(s < 60, F.concat(comma("%.2f", s), F.lit(" sn")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit(" dk "), two(whole % 60), F.lit(" sn")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" sa "), two(minutes % 60), F.lit(" dk "), two(whole % 60), F.lit(" sn")))
    )


def byte_rate(n: Column, seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "-").otherwise(F.concat(byte_size(n / seconds), F.lit("/sn")))


def row_rate(n: Column, seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "-").otherwise(F.concat(grouped(F.floor(n / seconds)), F.lit(" satır/sn")))


def percent(part: Column, whole: Column) -> Column:
    """A share from 0 to 100; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) * part / whole)))
