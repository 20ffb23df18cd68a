"""Numbered records of files of any size, read in byte ranges.

A split owns the records that start in it. One pass counts the starts in each
split, for both cases of a quote being open where it begins; the driver holds
three numbers for each split, runs through them in order and so knows every
split's first row number and whether it begins inside quotes. A second pass
reads the records, of all splits or of those that hold the wanted rows. Nothing
else is sequential. Splits grow with the data, MAX_SPLITS at most. A task takes
splits in a row, of about TASK_BYTES, so tasks grow with the bytes and not with
the splits. The planned splits are the index of the files: they can be kept as
Parquet and used again.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowlens.sources.detect import detect, open_path
from rowlens.spec import RECORD_BYTES, SourceError, SourceSpec

SPLIT_BYTES, MAX_SPLITS = 16 << 20, 100_000
#: Bytes of a task's splits, where there are enough for all cores; what opening a file counts as; tasks at most.
TASK_BYTES, OPEN_BYTES, MAX_TASKS = 4 << 20, 64 << 10, 10_000
#: Bytes read at a time beyond a split, for the end of its last record: at first, and at most.
FIRST_STEP, STEP_BYTES = 4 << 10, 1 << 20
BATCH_RECORDS, BATCH_BYTES = 5000, 4 << 20
SCHEMA = "row_no long, byte_offset long, line string"


class Split(NamedTuple):
    """A byte range of a file, and what the counting pass found out about it."""

    no: int
    path: str
    start: int
    end: int
    data_end: int
    first: bool
    row: int = 0
    inside: int = 0
    rows: int = 0


_SPLIT = "no long, path string, start long, end long, data_end long, first boolean, row long, inside int, rows long"


def splits_of(spec: SourceSpec, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Splits over the data regions of all files, in order."""
    step = max(split_bytes, -(-sum(b - a for _, a, b in spec.regions()) // MAX_SPLITS))
    bounds = [(path, at, min(at + step, b), b, at == a) for path, a, b in spec.regions() for at in range(a, b, step)]
    return [Split(i, *x) for i, x in enumerate(bounds)]


def _ends(block: bytes, quoted: bool, inside: int):
    """Positions of line feeds that end a record, and the quote state at the end."""
    x = np.frombuffer(block, np.uint8)
    feeds = np.flatnonzero(x == 10)
    if not quoted:
        return feeds, 0
    quotes = np.flatnonzero(x == 34)
    before = np.searchsorted(quotes, feeds)
    return feeds[(before + inside) % 2 == 0], (len(quotes) + inside) % 2


def _read(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(max(0, end - start))


def opened(splits):
    """(file, split) of splits; splits in a row of one file share its handle."""
    for path, held in groupby(splits, key=lambda s: s.path):
        fs, at = open_path(path)
        with fs.open_input_file(at) as f:
            for s in held:
                yield f, s


def split_counts(f, split: Split, quoted: bool) -> tuple[int, int, int]:
    """(record starts if no quote is open, if one is, parity of quotes) after a split's first byte."""
    block = _read(f, split.start, split.end)
    out = []
    for inside in (0, 1):
        ends, _ = _ends(block, quoted, inside)
        out.append(int((split.start + ends + 1 < split.data_end).sum()))
    return out[0], out[1], block.count(b'"') % 2 if quoted else 0


def split_records(f, split: Split, quoted: bool):
    """(offset, bytes) of the records after the record ends inside a split; a
    file's first split also has the one at its start."""
    start, end, data_end = split.start, split.end, split.data_end
    block = _read(f, start, end)
    ends, state = _ends(block, quoted, split.inside)
    bounds = [start] if split.first else []
    bounds += [start + int(e) + 1 for e in ends if start + e + 1 < data_end]
    if not bounds:
        return
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield a, block[a - start : b - start - 1]
    last, pos, step = bounds[-1], end, FIRST_STEP
    held = [block[last - start :]]
    while pos < data_end:
        more = _read(f, pos, min(pos + step, data_end))
        got, state = _ends(more, quoted, state)
        if len(got):
            held.append(more[: int(got[0])])
            break
        held.append(more)
        pos += len(more)
        step = min(2 * step, STEP_BYTES)
        if pos - last > RECORD_BYTES:
            raise SourceError(f"the record at byte {last} is longer than {RECORD_BYTES} bytes")
    raw = b"".join(held)
    yield last, raw[:-1] if pos >= data_end and raw.endswith(b"\n") else raw


def dealt(splits: list[Split], cores: int) -> list[list[Split]]:
    """The splits of each task, in order; a task for each core, if there are enough splits, and for TASK_BYTES."""
    before = [0, *accumulate(s.end - s.start + OPEN_BYTES * s.first for s in splits)]
    tasks = min(len(splits), MAX_TASKS, max(cores, -(-before[-1] // TASK_BYTES)))
    of = dict(zip(splits, (at * tasks // before[-1] for at in before), strict=False))
    return [list(held) for _, held in groupby(splits, key=of.get)]


def _table(spark: SparkSession, splits: list[Split]) -> DataFrame:
    """The splits, dealt to tasks in rows of about equal bytes."""
    sc = spark.sparkContext
    rows = dealt(splits, sc.defaultParallelism)
    return spark.createDataFrame(sc.parallelize(rows, max(1, len(rows))).flatMap(list), _SPLIT)


def plan(spark: SparkSession, spec: SourceSpec, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """The splits of the files with their first rows, quote states and numbers of records."""
    splits, quoted = splits_of(spec, split_bytes), spec.quoted

    def count(batches):
        for batch in batches:
            got = [(s.no, *split_counts(f, s, quoted)) for f, s in opened(Split(**s) for s in batch.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["no", "outside", "inside", "parity"])

    counts = {r.no: r for r in _table(spark, splits).mapInArrow(count, "no long, outside long, inside long, parity long").collect()} if splits else {}
    planned, row, inside = [], 0, 0
    for s in splits:
        inside = 0 if s.first else inside
        c = counts[s.no]
        rows = s.first + (c.inside if inside else c.outside)
        planned.append(s._replace(row=row, inside=inside, rows=rows))
        row, inside = row + rows, inside ^ c.parity
    return planned


def total(splits: list[Split]) -> int:
    return sum(s.rows for s in splits)


def holding(splits: list[Split], numbers) -> list[Split]:
    """The splits in which records of the given numbers start: row numbers, or a range of them."""
    full = [s for s in splits if s.rows]
    if isinstance(numbers, range):
        return [s for s in full if s.row < numbers.stop and s.row + s.rows > numbers.start]
    starts = [s.row for s in full]
    wanted = {bisect_right(starts, n) - 1 for n in numbers if 0 <= n < total(full)}
    return [full[i] for i in sorted(wanted)]


def read_lines(spark: SparkSession, spec: SourceSpec, split_bytes: int = SPLIT_BYTES, splits: list[Split] | None = None) -> DataFrame:
    """(row_no, byte_offset, line) of every record of the files, or of planned splits; offsets are those in a record's file."""
    splits = plan(spark, spec, split_bytes) if splits is None else splits
    quoted, encoding = spec.quoted, spec.encoding

    def read(batches):
        held, size = [], 0
        for f, s in opened(Split(**s) for batch in batches for s in batch.to_pylist()):
            for row, (offset, raw) in enumerate(split_records(f, s, quoted), s.row):
                held.append((row, offset, raw.decode(encoding, "replace").removesuffix("\r")))
                size += len(raw)
                if len(held) == BATCH_RECORDS or size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return _table(spark, splits).mapInArrow(read, SCHEMA)


def _batch(held) -> pa.RecordBatch:
    cols = list(zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["row_no", "byte_offset", "line"])


def save_index(spark: SparkSession, spec: SourceSpec, splits: list[Split], folder: str) -> None:
    """Keep planned splits as Parquet, with the size and the time of change of the data."""
    spark.createDataFrame(splits, _SPLIT).withColumns({"size": F.lit(spec.size), "modified": F.lit(spec.modified)}).write.parquet(folder)


def load_index(spark: SparkSession, spec: SourceSpec, folder: str) -> list[Split]:
    """Splits that were kept for the data as it is; an error if it has changed since."""
    rows = sorted(tuple(r) for r in spark.read.parquet(folder).collect())
    if any(r[-2:] != (spec.size, spec.modified) for r in rows) or {r[1] for r in rows} - {p for p, _, _ in spec.regions()}:
        raise SourceError("the data has changed since its index was written")
    return [Split(*r[:-2]) for r in rows]


class _Split(InputPartition):
    def __init__(self, split):
        self.split = split


class RecordLines(DataSource):
    """spark.read.format("recordlines").load(path): (byte_offset, line), unquoted."""

    @classmethod
    def name(cls):
        return "recordlines"

    def schema(self):
        return "byte_offset long, line string"

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.spec = detect(options["path"], kind=options.get("kind"), quoted=False)
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        return [_Split(s) for s in splits_of(self.spec, self.split_bytes)]

    def read(self, partition):
        for f, split in opened([partition.split]):
            for offset, raw in split_records(f, split, False):
                yield offset, raw.decode(self.spec.encoding, "replace").removesuffix("\r")
