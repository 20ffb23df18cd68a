"""Budgeted imports: documents to a Parquet store with a manifest.

Records are picked from a document by a selector, checked against limits and
written once, into a new folder; the manifest goes last and says how the
import ended. A preview stops early and never counts as complete. JSON and
YAML lists are decoded incrementally, element by element; a document is one
sequential stream, so it is read by one task, many documents by many.
"""

from __future__ import annotations

import csv
import io
import json
import shutil
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.sources.detect import encoding_of, kind_of, open_path
from rowlens.sources.documents import _element, _plain, yaml
from rowlens.spec import SourceError

PREVIEW_RECORDS, PREVIEW_BYTES, MAX_DEPTH, MAX_RECORD_BYTES, FREE_BYTES = 1000, 32 << 20, 1000, 200 << 20, 200 << 20
CHUNK = 1 << 20
# How an import can end.
OUTCOMES = (
    "complete", "preview_complete", "record_limit", "byte_limit", "selector_not_found", "invalid_document", "trailing_data",
    "record_too_large", "record_too_deep", "width_mismatch", "empty_source", "unsupported_encoding", "disk_full",
)


class Stop(Exception):
    """The end of an import before its natural one."""

    def __init__(self, outcome: str, why: str = ""):
        super().__init__(why or outcome)
        self.outcome = outcome


@dataclass(frozen=True)
class Selector:
    """Where the records are: root_array, name, index (from 1), first_array; a path for XML."""

    kind: str = "root_array"
    name: str | None = None
    index: int | None = None
    path: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("root_array", "name", "index", "first_array", "path", "rows"):
            raise ValueError(f"unknown selector: {self.kind}")
        if self.kind == "name" and not self.name or self.kind == "index" and (self.index or 0) < 1 or self.kind == "path" and not self.path:
            raise ValueError(f"selector {self.kind} lacks its value")


def check_config(path: str, selector: Selector, max_records: int | None = None, max_bytes: int | None = None) -> str:
    """The kind of the file, if selector and limits suit it."""
    kind = kind_of(path)
    fits = {"csv": ("rows",), "xml": ("path",), "json": ("root_array", "name", "index", "first_array"), "yaml": ("root_array", "name", "index")}
    if selector.kind not in fits[kind]:
        raise ValueError(f"selector {selector.kind} does not suit {kind}")
    if (max_records or 1) < 1 or (max_bytes or 1) < 1:
        raise ValueError("limits must be positive")
    return kind


class Budget(io.RawIOBase):
    """Bytes of a stream up to a limit; knows whether the limit or the file ended it."""

    def __init__(self, f, limit: int | None = None):
        self.f, self.left, self.cut = f, limit, False

    def readable(self):
        return True

    def readinto(self, b):
        want = len(b) if self.left is None else min(len(b), self.left)
        got = self.f.read(want) if want else b""
        if not want and self.left is not None and self.f.read(1):
            self.cut = True
        b[: len(got)] = got
        if self.left is not None:
            self.left -= len(got)
        return len(got)


class _Text:
    """A decoded stream with a look-ahead buffer."""

    def __init__(self, raw, encoding: str):
        self.raw = raw
        self.f, self.buf, self.end = io.TextIOWrapper(io.BufferedReader(raw, CHUNK), encoding, errors="strict", newline=""), "", False

    def more(self) -> bool:
        got = self.f.read(CHUNK) if not self.end else ""
        self.end = self.end or not got
        self.buf += got
        return bool(got)

    def peek(self) -> str:
        while True:
            s = self.buf.lstrip(" \t\r\n")
            if s or not self.more():
                self.buf = s
                return s[:1]

    def take(self, c: str) -> bool:
        if self.peek() == c:
            self.buf = self.buf[1:]
            return True
        return False

    def value(self):
        """The JSON value at the front."""
        self.peek()
        decoder = json.JSONDecoder()
        while True:
            try:
                v, n = decoder.raw_decode(self.buf)
                if n < len(self.buf) or self.end:
                    self.buf = self.buf[n:]
                    return v
            except RecursionError:
                raise Stop("record_too_deep") from None
            except json.JSONDecodeError:
                if self.end:
                    raise Stop("byte_limit" if self.raw.cut else "invalid_document") from None
            if len(self.buf) > MAX_RECORD_BYTES:
                raise Stop("record_too_large")
            self.more()


def _depth(v) -> int:
    level, n = [v], 0
    while level:
        level = [x for y in level if isinstance(y, (dict, list)) for x in (y.values() if isinstance(y, dict) else y)]
        n += 1
    return n


def _elements(t: _Text):
    if not t.take("["):
        raise Stop("invalid_document")
    if t.take("]"):
        return
    while True:
        v = t.value()
        if _depth(v) > MAX_DEPTH:
            raise Stop("record_too_deep")
        if not isinstance(v, (dict, list, str)) and not t.peek() and t.raw.cut:
            raise Stop("byte_limit")  # the scalar may go on beyond the budget
        yield v
        if t.take("]"):
            return
        if not t.take(","):
            raise Stop("byte_limit" if t.raw.cut else "invalid_document")


def json_stream(raw, encoding: str, s: Selector):
    """Complete elements of the selected array; the rest of the document is checked."""
    t = _Text(raw, encoding)
    if not t.peek():
        raise Stop("empty_source")
    if s.kind in ("root_array", "first_array") and t.peek() == "[":
        yield from _elements(t)
    elif s.kind == "root_array" or t.peek() != "{":
        raise Stop("selector_not_found")
    else:
        t.take("{")
        seen, found = 0, False
        while not t.take("}"):
            name = t.value()
            if not t.take(":"):
                raise Stop("byte_limit" if raw.cut else "invalid_document")
            array = t.peek() == "["
            seen += array
            if not found and array and (s.kind == "first_array" or s.kind == "name" and name == s.name or s.kind == "index" and seen == s.index):
                found = True
                yield from _elements(t)
            else:
                t.value()
            if not t.take(",") and t.peek() != "}":
                raise Stop("byte_limit" if raw.cut else "invalid_document")
        if not found:
            raise Stop("selector_not_found")
    if t.peek():
        raise Stop("trailing_data")


def csv_stream(raw, encoding: str, s: Selector, max_field: int = 10 << 20):
    """Rows as lists below a checked header, which comes first as a dict."""
    csv.field_size_limit(max_field)
    text, header, n = io.TextIOWrapper(io.BufferedReader(raw, CHUNK), encoding, newline=""), None, 0
    try:
        for row in csv.reader(text, strict=True):
            if not row:
                continue
            if header is None:
                if any(not h.strip() for h in row) or len(set(row)) < len(row):
                    raise Stop("invalid_document", "the header has an empty or a repeated name")
                header = row
                yield {"header": header}
            elif len(row) != len(header):
                raise Stop("byte_limit" if raw.cut else "width_mismatch", f"record {n + 1}")
            else:
                n += 1
                yield row
    except csv.Error as e:
        raise Stop("byte_limit" if raw.cut else "invalid_document", str(e)) from None
    if header is None:
        raise Stop("empty_source")


def xml_stream(raw, encoding: str, s: Selector):
    """Elements at a path below the root, by local name or {namespace}name."""
    local, path, found = (lambda t: t.rpartition("}")[2]), [], False
    try:
        for event, e in ET.iterparse(io.BufferedReader(raw, CHUNK), ("start", "end")):
            if event == "start":
                path.append(e.tag)
                continue
            here = path[1:]
            hit = len(here) == len(s.path) and all(p in (t, local(t)) for p, t in zip(s.path, here, strict=True))
            path.pop()
            if hit:
                found = True
                v = _element(e)
                yield v if isinstance(v, dict) else {e.tag: v}
            if hit or len(here) <= len(s.path):
                e.clear()
    except ET.ParseError as e:
        raise Stop("byte_limit" if raw.cut else "invalid_document", str(e)) from None
    except SourceError as e:
        raise Stop("invalid_document", str(e)) from None
    if not found:
        raise Stop("selector_not_found")


def yaml_stream(raw, encoding: str, s: Selector):
    """Items of the selected block list, composed one by one; no anchors, aliases or second document."""
    if yaml is None:
        raise Stop("invalid_document", "YAML needs PyYAML")
    loader = yaml.SafeLoader(io.TextIOWrapper(io.BufferedReader(raw, CHUNK), encoding))

    def node():
        if loader.check_event(yaml.AliasEvent) or getattr(loader.peek_event(), "anchor", None):
            raise Stop("invalid_document", "anchors and aliases are not supported")
        return _plain(loader.construct_document(loader.compose_node(None, None)))

    def items():
        loader.get_event()
        while not loader.check_event(yaml.SequenceEndEvent):
            yield node()
        loader.get_event()

    try:
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            raise Stop("empty_source")
        loader.get_event()
        if s.kind == "root_array":
            if not loader.check_event(yaml.SequenceStartEvent):
                raise Stop("selector_not_found")
            yield from items()
        else:
            if not loader.check_event(yaml.MappingStartEvent):
                raise Stop("selector_not_found")
            loader.get_event()
            seen, found = 0, False
            while not loader.check_event(yaml.MappingEndEvent):
                name = node()
                array = loader.check_event(yaml.SequenceStartEvent)
                seen += array
                if not found and array and (s.kind == "name" and name == s.name or s.kind == "index" and seen == s.index):
                    found = True
                    yield from items()
                else:
                    node()
            loader.get_event()
            if not found:
                raise Stop("selector_not_found")
        loader.get_event()
        if not loader.check_event(yaml.StreamEndEvent):
            raise Stop("trailing_data", "more than one document")
    except (yaml.YAMLError, SourceError) as e:
        raise Stop("byte_limit" if raw.cut else "invalid_document", str(e)) from None


STREAMS = {"json": json_stream, "csv": csv_stream, "xml": xml_stream, "yaml": yaml_stream}


def kind_name(v) -> str:
    return "object" if isinstance(v, dict) else "positional" if isinstance(v, list) else "scalar"


def _import_one(path: str, kind: str, selector: Selector, max_records, max_bytes):
    """(row_id, kind, record) of a document, then one row with how it ended."""
    fs, at = open_path(path)
    n, outcome, why, header = 0, "complete", "", None
    with fs.open_input_stream(at) as f, fs.open_input_file(at) as g:
        raw = Budget(f, max_bytes)
        try:
            try:
                encoding = encoding_of(g.read(4))
            except SourceError as e:
                raise Stop("unsupported_encoding", str(e)) from None
            for v in STREAMS[kind](raw, encoding, selector):
                if kind == "csv" and isinstance(v, dict):
                    header = v["header"]
                    continue
                if max_records is not None and n >= max_records:
                    raise Stop("record_limit")
                text = json.dumps(v, ensure_ascii=False)
                if len(text) > MAX_RECORD_BYTES:
                    raise Stop("record_too_large")
                yield n, kind_name(v), text
                n += 1
            if raw.cut:
                raise Stop("byte_limit")
        except Stop as e:
            outcome, why = e.outcome, str(e)
        except UnicodeDecodeError:
            outcome = "byte_limit" if raw.cut else "unsupported_encoding"
    yield None, outcome, json.dumps({"records": n, "why": why, "header": header})


def records(spark: SparkSession, paths: list[str], selector: Selector, max_records: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, row_id, kind, record); each document's last row has a null row_id, its outcome as kind."""
    kinds = {p: check_config(p, selector, max_records, max_bytes) for p in paths}

    def run(frames):
        for frame in frames:
            for p in frame["path"]:
                held = []
                for row in _import_one(p, kinds[p], selector, max_records, max_bytes):
                    held.append((p, *row))
                    if len(held) == 1000:
                        yield _frame(held)
                        held = []
                if held:
                    yield _frame(held)

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return table.mapInPandas(run, "path string, row_id long, kind string, record string")


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "row_id", "kind", "record"])
    return out.assign(row_id=out["row_id"].astype("Int64"))


@dataclass(frozen=True)
class Manifest:
    source: str
    selector: dict
    mode: str
    outcome: str
    records: int
    kinds: dict
    header: list | None
    complete: bool
    why: str


def import_document(spark: SparkSession, path: str, out_dir: str, selector: Selector, preview: bool = False, max_records: int | None = None, max_bytes: int | None = None) -> Manifest:
    """Import a document into a new folder: Parquet records and MANIFEST.json."""
    if preview:
        max_records, max_bytes = max_records or PREVIEW_RECORDS, max_bytes or PREVIEW_BYTES
    fs, at = open_path(out_dir)
    if fs.get_file_info(at).type.name != "NotFound":
        raise SourceError("the target folder exists; a store is never overwritten")
    fs.create_dir(at, recursive=True)
    if fs.type_name == "local" and shutil.disk_usage(at).free < FREE_BYTES:
        raise Stop("disk_full")
    store = f"{out_dir.rstrip('/')}/records"
    records(spark, [path], selector, max_records, max_bytes).write.parquet(store)
    got = spark.read.parquet(store)
    end = got.where("row_id is null").first()
    info = json.loads(end.record)
    kinds = {r.kind: r["count"] for r in got.where("row_id is not null").groupBy("kind").count().collect()}
    outcome = "preview_complete" if preview and end.kind == "complete" else end.kind
    m = Manifest(path, asdict(selector), "preview" if preview else "full", outcome, info["records"], kinds, info["header"], outcome == "complete", info["why"])
    with fs.open_output_stream(f"{at}/MANIFEST.json") as f:
        f.write(json.dumps(asdict(m), ensure_ascii=False, indent=1).encode())
    return m


def open_store(spark: SparkSession, out_dir: str) -> tuple[DataFrame, Manifest]:
    fs, at = open_path(out_dir)
    with fs.open_input_stream(f"{at}/MANIFEST.json") as f:
        m = Manifest(**json.loads(f.read()))
    m.selector["path"] = tuple(m.selector["path"])  # JSON has no tuples
    return spark.read.parquet(f"{out_dir.rstrip('/')}/records").where(F.col("row_id").isNotNull()).select("row_id", "kind", "record"), m


def main(argv=None) -> int:
    import argparse

    p = argparse.ArgumentParser(description="Import the records of a document into a Parquet store.")
    p.add_argument("--source", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--selector", default="root_array", help="root_array, first_array, rows, name:N, index:K or path:a/b")
    p.add_argument("--max-bytes", type=int)
    p.add_argument("--max-records", type=int)
    a = p.parse_args(argv)
    kind, _, value = a.selector.partition(":")
    selector = Selector(kind, name=value or None if kind == "name" else None, index=int(value) if kind == "index" else None, path=tuple(value.split("/")) if kind == "path" else ())
    spark = SparkSession.builder.getOrCreate()
    m = import_document(spark, a.source, a.out_dir, selector, max_records=a.max_records, max_bytes=a.max_bytes)
    print(json.dumps(asdict(m), ensure_ascii=False))
    return 0 if m.complete else 1


if __name__ == "__main__":
    raise SystemExit(main())
