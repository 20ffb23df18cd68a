"""A handle over opened files: rows, search, sorts, selection, export."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.functions import b64
from rowlens.operators import navigate, order, search
from rowlens.operators.select import Selection, selected
from rowlens.sources import export
from rowlens.sources.decode import all_columns, named
from rowlens.sources.detect import detect, files_of, open_path, with_parts
from rowlens.sources.lines import SPLIT_BYTES, Split, holding, load_index, plan, read_lines, save_index, total
from rowlens.spec import PAGE_ROWS, SELECTION_ROWS, SearchSpec, SortSpec, SourceError, SourceSpec


class Dataset:
    """The records of a file, or of files in a row, as numbered, named rows; every result is a DataFrame.

    Row numbers need one pass that counts; its result, the splits, is kept. Reads
    of known rows take only the splits that hold them.
    """

    def __init__(self, spark: SparkSession, spec: SourceSpec, page_rows: int = PAGE_ROWS, split_bytes: int = SPLIT_BYTES):
        self.spark, self.spec, self.page_rows, self.split_bytes = spark, spec, page_rows, split_bytes
        self._rows: DataFrame | None = None
        self._splits: list[Split] | None = None
        self.view: DataFrame | None = None
        self.selection = Selection()

    @property
    def table(self) -> DataFrame:
        if self._rows is None:
            self._rows = self._read(self.splits)
        return self._rows

    @property
    def splits(self) -> list[Split]:
        """The index: byte ranges with their first rows, from one counting pass."""
        if self._splits is None:
            self._splits = plan(self.spark, self.spec, self.split_bytes)
        return self._splits

    def save_index(self, folder: str) -> None:
        """Keep the index; open_file(..., index=folder) spares the counting pass."""
        save_index(self.spark, self.spec, self.splits, folder)

    def _read(self, splits: list[Split]) -> DataFrame:
        return named(read_lines(self.spark, self.spec, splits=splits), self.spec)

    def close(self) -> None:
        self._rows = self.view = None

    def number_rows(self) -> DataFrame:
        """Keep the numbered rows for repeated use (spills to disk)."""
        self._rows = self.table.persist()
        return self._rows

    def count(self) -> int:
        return total(self.splits)

    def estimate(self) -> int:
        return self.spec.estimate()

    def pages(self) -> int:
        return max(1, -(-self.count() // self.page_rows))

    def rows(self, start: int, n: int) -> DataFrame:
        return navigate.window_rows(self._read(holding(self.splits, range(start, start + n))), start, n)

    def fetch(self, ids: list[int]) -> DataFrame:
        return navigate.fetch(self._read(holding(self.splits, ids)), ids)

    def goto(self, n: int) -> DataFrame:
        return navigate.go_to(self._read(holding(self.splits, [n])), n, self.count(), self.page_rows)

    def search(self, text: str, case: bool = False, regex: bool = False, limit: int | None = None, from_row: int | None = None, from_offset: int | None = None) -> DataFrame:
        """Occurrences from a row, or in one file from a byte offset, on; offset is their place in their file."""
        if from_offset is not None and self.spec.parts:
            raise SourceError("many files have no common byte offset; start at a row")
        spec = SearchSpec(text, case, regex, **({"limit": limit} if limit else {}))
        lines = read_lines(self.spark, self.spec, splits=[s for s in self.splits if s.row + s.rows > (from_row or 0)])
        return search.search_hits(lines, spec, raw="line", start_row=from_row, offset="byte_offset", start_offset=from_offset)

    def _set(self, view: DataFrame) -> DataFrame:
        self.view = view
        return view

    def top_k(self, column: str, k: int, descending: bool = False, kind: str = "text") -> DataFrame:
        return self._set(order.top_k(self.table, SortSpec(column, descending, kind), k))

    def sort_page(self, column: str, page: int, descending: bool = False, kind: str = "text") -> DataFrame:
        return self._set(order.sort_page(self.table, SortSpec(column, descending, kind), page * self.page_rows, self.page_rows))

    def sort_list(self, column: str, ids: list[int], descending: bool = False, kind: str = "text") -> DataFrame:
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "input_pos long, row_no long")
        return self._set(order.sort_list(self.table, SortSpec(column, descending, kind), wanted))

    def reset_view(self) -> None:
        self.view = None

    def source_changed(self) -> bool:
        """Whether size or time of change of the files differ from when they were opened."""
        held = [fs.get_file_info(at) for fs, at in (open_path(path) for path, _, _ in self.spec.regions())]
        times = [i.mtime.timestamp() if i.mtime else 0.0 for i in held]
        return (sum(i.size or 0 for i in held), max(times)) != (self.spec.size, self.spec.modified)

    def integrity(self) -> DataFrame:
        """One row: exact and declared number of records, and the difference."""
        exact, declared = F.lit(self.count()).cast("long"), F.lit(self.spec.declared).cast("long")
        return self.spark.range(1).select(exact.alias("exact"), declared.alias("declared"), (exact - declared).alias("difference"))

    def b64_decode(self, spec) -> DataFrame:
        text = b64.extract(F.col("cells"), spec)
        rows = self.table.select("row_no", text.alias("b64"))
        out = rows.select("row_no", "b64", b64.problem(F.col("b64"), spec.url).alias("problem"), b64.decode(F.col("b64"), spec.url).alias("bytes"))
        return out.withColumn("decoded", b64.bytes_to_text(F.col("bytes"), spec.encodings)).select("row_no", "problem", "bytes", "decoded.text", "decoded.encoding", b64.file_type(F.col("bytes")).alias("file_type"))

    def b64_suggest(self, n: int):
        found = self.table.where(F.col("row_no") == n).select("cells").first()
        return b64.suggest(found.cells) if found else None

    def export(self, fmt: str, path: str, title: str = "", ids: list[int] | None = None, columns: list[str] | None = None) -> None:
        columns = columns or list(self.spec.columns)
        ids = self.selection.rows() if ids is None else ids
        if len(ids) > SELECTION_ROWS:
            raise ValueError(f"an export takes {SELECTION_ROWS} rows at most")
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "sel_pos long, row_no long")
        chosen = selected(self._read(holding(self.splits, ids)), wanted)
        if fmt == "parts":
            export.write_parts(chosen, columns, path)
            return
        rows = export.rows_of(chosen, columns)
        if fmt in ("xlsx", "docx"):
            {"xlsx": export.write_xlsx, "docx": export.write_docx}[fmt](path, title, columns, rows)
        elif fmt == "pdf":
            with open(path, "wb") as f:
                export.write_pdf(f, title, columns, rows)
        elif fmt in ("tsv", "html"):
            with open(path, "w", encoding="utf-8") as f:
                if fmt == "tsv":
                    export.write_tsv(f, columns, rows)
                else:
                    f.write(export.html_page(title, columns, rows))
        else:
            raise ValueError(f"unknown format: {fmt}")


def open_file(spark: SparkSession, path: str, page_rows: int = PAGE_ROWS, split_bytes: int = SPLIT_BYTES, columns: str = "sample", index: str | None = None, **settings) -> Dataset:
    """Open a file, or the files of a folder or glob in the order of their names.

    Settings are as for rowlens.sources.detect.detect(); many files have the
    format of the first. Columns are those of the sample's first records;
    columns="all" reads JSON or YAML once more for the keys of all records.
    index: a folder of Dataset.save_index().
    """
    if columns not in ("sample", "all"):
        raise ValueError(f"unknown columns: {columns}")
    names = files_of(path)
    spec = detect(names[0], **settings)
    if len(names) > 1:
        spec = with_parts(spark, spec, path, names, settings.get("compat_tail", False))
    data = Dataset(spark, spec, page_rows, split_bytes)
    if index is not None:
        data._splits = load_index(spark, spec, index)
    if columns == "all":
        data.spec = replace(spec, columns=all_columns(read_lines(spark, spec, splits=data.splits), spec))
    return data
