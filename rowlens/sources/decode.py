"""Lines to cells, and cells to named columns, for the four line formats."""

from __future__ import annotations

import csv
import json
import re
import xml.etree.ElementTree as ET
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.text import as_text
from rowlens.operators.navigate import column_names, rows_from_cells
from rowlens.spec import SourceError, SourceSpec

try:
    import yaml
except ImportError:  # flow records that are JSON still work
    yaml = None


def json_value(line: str):
    """The array or object on a line, without one closing comma; None if there is none."""
    s = line.strip()
    s = s[:-1].rstrip() if s.endswith(",") else s
    if s[:1] not in ("[", "{"):
        return None
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        return None


def yaml_value(line: str):
    """The item after ``- ``: as JSON if it is, else as YAML; a scalar is a list of one."""
    s = line.strip()
    if not s.startswith("- "):
        return None
    try:
        v = json.loads(s[2:])
    except (ValueError, RecursionError):
        if yaml is None:
            return None
        try:
            v = yaml.safe_load(s[2:])
        except yaml.YAMLError:
            return None
    return v if isinstance(v, (list, dict)) else [v]


def xml_value(line: str, tag: str | None):
    """[(child, text)] of the element on a line; an element of text alone has one unnamed cell."""
    s = line.strip()
    if not s.startswith("<"):
        return None
    try:
        e = ET.fromstring(s)
    except ET.ParseError:
        return None
    plain = lambda t: re.sub(r"^\{[^}]*\}", "", t)
    if tag is not None and plain(e.tag) != re.sub(r"^.*:", "", tag):
        return None
    children = [(plain(c.tag), c.text or "") for c in e]
    return children or [("", e.text or "")]


@contextmanager
def cells_up_to(chars: int):
    """Let csv read cells of so many characters; its limit holds for the process and is put back."""
    before = csv.field_size_limit(max(chars, csv.field_size_limit()))
    try:
        yield
    finally:
        csv.field_size_limit(before)


def quoted_rows(lines: list[str], delimiter: str, data: str = "\r") -> list[list[str]]:
    """Rows of text with quotes. The characters of data are text in and out of quotes:
    csv cuts rows at them or refuses them, so they pass it as characters the lines don't have."""
    text = "".join(lines)
    spare = (c for c in map(chr, range(0xE000, 0x110000)) if c != delimiter and c not in text)
    swap = {c: next(spare) for c in data if c in text}
    back = str.maketrans({v: k for k, v in swap.items()})
    rows = csv.reader([x.translate(str.maketrans(swap)) for x in lines] if swap else lines, delimiter=delimiter)
    return [[c.translate(back) for c in r] for r in rows] if swap else list(rows)


def to_cells(value, columns) -> list[str]:
    if isinstance(value, dict):
        return [as_text(value.get(c)) for c in columns]
    return [as_text(v[1] if isinstance(v, tuple) else v) for v in value]


def _cells(spec: SourceSpec):
    def one(line: str):
        if spec.kind == "csv":
            return quoted_rows([line], spec.delimiter, "\r\n")[0]
        v = json_value(line) if spec.kind == "json" else yaml_value(line) if spec.kind == "yaml" else xml_value(line, spec.tag)
        return [line] if v is None else to_cells(v, spec.columns)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lines: pd.Series) -> pd.Series:
        with cells_up_to(max(map(len, lines), default=0)):
            return lines.map(one)

    return run


def cells(line: Column, spec: SourceSpec) -> Column:
    """array<string>: the cells of a record; a line that is no record is one cell.

    Unquoted text is split by an expression and stays out of Python.
    """
    if spec.kind == "csv" and not spec.quoted:
        return F.split(line, "\\Q" + spec.delimiter + "\\E", -1)
    return _cells(spec)(line)


def all_columns(lines: DataFrame, spec: SourceSpec) -> tuple[str, ...]:
    """First-seen keys over all object records of a JSON or YAML file, else numbered
    columns of the longest; one row for each name comes to the driver."""
    if spec.kind not in ("json", "yaml"):
        raise ValueError(f"columns of all records are for JSON and YAML, not {spec.kind}")
    value = json_value if spec.kind == "json" else yaml_value

    def keys(line: str):
        v = value(line)
        if isinstance(v, dict) and not all(isinstance(k, str) for k in v):
            raise SourceError("a key is not a text")
        return {"keys": list(v) if isinstance(v, dict) else None, "width": 1 if v is None else len(v)}

    @F.pandas_udf("keys array<string>, width int")
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([keys(x) for x in lines], columns=["keys", "width"])

    found = lines.select("row_no", run("line").alias("v"))
    each = found.select("row_no", F.posexplode("v.keys").alias("at", "name"))
    first = each.groupBy("name").agg(F.min(F.struct("row_no", "at")).alias("first")).orderBy("first").collect()
    if first:
        return tuple(r["name"] for r in first)
    return tuple(column_names(found.agg(F.max("v.width")).first()[0] or 1))


def named(lines: DataFrame, spec: SourceSpec) -> DataFrame:
    """(row_no, byte_offset, line, cells and a text column for each name)."""
    held = lines.withColumn("cells", cells(F.col("line"), spec))
    return held.select("row_no", "byte_offset", "line", "cells", *rows_from_cells(F.col("cells"), list(spec.columns)))
