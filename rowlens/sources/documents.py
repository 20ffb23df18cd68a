"""Strict whole-document readers: JSON, CSV, XML, YAML to records of JSON text.

Files are read by Spark as binaryFile rows, one parser call for each file, so
many documents parse in parallel; a single large one is for the line readers
or for rowlens.streaming.ingest. Each gives (path, row_id, record), record a
JSON object (or array for ragged data) with its values typed.
"""

from __future__ import annotations

import csv
import io
import json
import math
import xml.etree.ElementTree as ET
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rowlens.sources.decode import cells_up_to
from rowlens.sources.detect import encoding_of, kind_of
from rowlens.spec import SourceError

try:
    import yaml
except ImportError:
    yaml = None

MAX_BYTES = 300 << 20


def _unique(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise SourceError("a JSON object repeats a key")
    return out


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise SourceError("a JSON number is out of range")
    return x


def _no_constant(name: str):
    raise SourceError(f"{name} is not JSON")


def _rooted(root, what: str) -> list[dict]:
    if isinstance(root, dict):
        return [root]
    if isinstance(root, list):
        if all(isinstance(r, dict) for r in root):
            return root
        raise SourceError(f"a {what} list must hold objects only")
    raise SourceError(f"a {what} document must be an object or a list of objects")


def json_records(text: str) -> list[dict]:
    """An object is one record, a list of objects many; repeated keys, NaN and overflow are errors."""
    try:
        root = json.loads(text, object_pairs_hook=_unique, parse_float=_finite, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        raise SourceError(f"not JSON at line {e.lineno}, column {e.colno}") from None
    return _rooted(root, "JSON")


def _csv_rows(text: str):
    with cells_up_to(len(text)):
        yield from csv.reader(io.StringIO(text, newline=""), strict=True)


def csv_records(text: str) -> list[dict]:
    """Comma and quote, first full row as header, all values text; widths must agree."""
    header, out = None, []
    try:
        for row in _csv_rows(text):
            if not row:
                continue
            if header is None:
                header = row
                if any(not h.strip() for h in header) or len(set(header)) < len(header):
                    raise SourceError("the header has an empty or a repeated name")
            elif len(row) != len(header):
                raise SourceError(f"record {len(out) + 1} has {len(row)} values, the header {len(header)}")
            else:
                out.append(dict(zip(header, row, strict=True)))
    except csv.Error as e:
        raise SourceError(f"not CSV: {e}") from None
    if header is None:
        raise SourceError("the file has no header")
    return out


def _element(e):
    """Text of a plain element, else a dict: @ attributes, children, repeats as lists."""
    if len(e) == 0 and not e.attrib:
        return e.text or ""
    out = {f"@{k}": v for k, v in e.attrib.items()}
    texts = [e.text, *(c.tail for c in e)]
    mixed = any(t and t.strip() for t in texts)
    if len(e) and mixed:
        raise SourceError(f"element {e.tag} mixes text and elements")
    if mixed:
        out["#text"] = e.text
    seen: dict[str, int] = {}
    for c in e:
        n, v = seen.get(c.tag, 0), _element(c)
        if n == 0:
            out[c.tag] = v
        elif n == 1:
            out[c.tag] = [out[c.tag], v]
        else:
            out[c.tag].append(v)
        seen[c.tag] = n + 1
    return out


def xml_records(text: str | bytes) -> list[dict]:
    """The root's children are the records."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise SourceError(f"not XML at line {e.position[0]}") from None
    if root.text and root.text.strip() or any(c.tail and c.tail.strip() for c in root):
        raise SourceError("the root mixes text and records")
    out = [_element(c) for c in root]
    if any(not isinstance(r, dict) for r in out):
        raise SourceError("a record has no fields")
    return out


def _plain(v, above=()):
    if id(v) in above:
        raise SourceError("the YAML document contains itself")
    if isinstance(v, dict):
        if any(not isinstance(k, str) for k in v):
            raise SourceError("a YAML key is no text")
        return {k: _plain(x, (*above, id(v))) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x, (*above, id(v))) for x in v]
    if isinstance(v, (date, datetime, bytes, set, tuple)):
        raise SourceError(f"a YAML value of type {type(v).__name__} is not supported")
    if isinstance(v, float) and not math.isfinite(v):
        raise SourceError("a YAML number is not finite")
    return v


def yaml_records(text: str) -> list[dict]:
    if yaml is None:
        raise SourceError("YAML documents need PyYAML")
    try:
        root = yaml.safe_load(text)
    except yaml.YAMLError:
        raise SourceError("not YAML") from None
    return _rooted(_plain(root), "YAML")


PARSERS = {"json": json_records, "csv": csv_records, "xml": xml_records, "yaml": yaml_records}


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, row_id, record) of the documents at a path or glob."""
    kind = kind or kind_of(path)
    if kind not in PARSERS:
        raise SourceError(f"unknown kind: {kind}")

    def parse(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                if len(raw) > MAX_BYTES:
                    raise SourceError(f"documents over {MAX_BYTES} bytes are read by the import")
                if not raw:
                    raise SourceError("the file is empty")
                text = bytes(raw).decode(encoding_of(bytes(raw[:4])))
                records = PARSERS[kind](text)
                yield pd.DataFrame({"path": name, "row_id": range(len(records)), "record": [json.dumps(r, ensure_ascii=False) for r in records]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row_id long, record string")
