"""Paging, random access, projection and row checks over numbered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.spec import LEGACY_PAGE_ROWS, PAGE_ROWS


def window_rows(rows: DataFrame, start: int, count: int, row_no: str = "row_no") -> DataFrame:
    """Rows [start, start + count), fewer at the end; the range reaches the scan."""
    return rows.where(F.col(row_no).between(start, start + count - 1)).orderBy(row_no)


def fetch(rows: DataFrame, ids: list[int], row_no: str = "row_no") -> DataFrame:
    """The given rows in the given order, with their place as fetch_pos; missing ones are left out."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"fetch_pos long, {row_no} long")
    return fetch_table(rows, wanted, row_no)


def fetch_table(rows: DataFrame, wanted: DataFrame, row_no: str = "row_no") -> DataFrame:
    """As fetch(), for a table (fetch_pos, row_no) of any size."""
    return rows.join(wanted, row_no).orderBy("fetch_pos")


def go_to(rows: DataFrame, n: int, total: int | None = None, page_rows: int = PAGE_ROWS, row_no: str = "row_no") -> DataFrame:
    """Row n with its page number; a known total is checked."""
    if n < 0 or (total is not None and n >= total):
        raise IndexError(f"row {n} is outside the data")
    return rows.where(F.col(row_no) == n).withColumn("page", F.lit(n // page_rows).cast("long"))


def page_bounds(page: int, total: int | None = None, page_rows: int = PAGE_ROWS) -> tuple[int, int]:
    """[start, end) of a page; a known total cuts the last one."""
    start, end = page * page_rows, (page + 1) * page_rows
    return (start, end) if total is None else (min(start, total), min(end, total))


def page_count(rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row: total and pages, one page at least."""
    n = F.count("*")
    return rows.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / page_rows)).cast("long").alias("pages"))


def view_page(view: DataFrame, start: int, count: int) -> DataFrame:
    return view.where(F.col("view_pos").between(start, start + count - 1)).orderBy("view_pos")


def visible(rows: DataFrame, columns: list[str], row_no: str = "row_no") -> DataFrame:
    """A projection for show; null cells are empty."""
    return rows.select(row_no, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def width_check(cells: Column, columns: int) -> list[Column]:
    """(mismatched, shown): whether the width differs, and the cells cut or filled up to it."""
    fill = F.array_repeat(F.lit(""), F.greatest(F.lit(columns) - F.size(cells), F.lit(0)))
    return [(F.size(cells) != columns).alias("mismatched"), F.concat(F.slice(cells, 1, columns), fill).alias("shown")]


def shown_number(row_no: Column, base: int = 1) -> Column:
    return row_no + F.lit(base)


def legacy_page(view: DataFrame, page: int, total: int, size: int = LEGACY_PAGE_ROWS) -> DataFrame:
    """A page of 500 rows of a view; the number is kept inside the pages there are."""
    page = max(0, min(page, (max(total, 1) - 1) // size))
    return view_page(view, page * size, size)


def at_position(view: DataFrame, position: int, total: int) -> DataFrame:
    """The row at a 1-based place in the view."""
    if not 1 <= position <= total:
        raise IndexError(f"place {position} is outside the view")
    return view.where(F.col("view_pos") == position - 1)


def position_of(view: DataFrame, row_id: int, name: str = "row_no") -> DataFrame:
    return view.where(F.col(name) == row_id).select("view_pos")


def record_by_id(store: DataFrame, row_id: int) -> DataFrame:
    return store.where(F.col("row_id") == row_id)


def first_seen_columns(rows: DataFrame, json: str, row_no: str = "row_no") -> DataFrame:
    """(position, name): keys of JSON objects in the order in which they first appear."""
    keys = rows.select(F.col(row_no).alias("r"), F.posexplode(F.json_object_keys(json)).alias("p", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("r", "p")).alias("at"))
    from pyspark.sql import Window

    # one row for each distinct column name
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("position"), "name")


def cell(values: Column, name: str) -> Column:
    """A cell of a map by key; null where the key is absent."""
    return F.try_element_at(values, F.lit(name))


def positional_cell(cells: Column, index: int) -> Column:
    return F.get(cells, F.lit(index))


def column_names(width: int) -> list[str]:
    return [f"Kolon {i + 1}" for i in range(width)]


def rows_from_cells(cells: Column, columns: list[str]) -> list[Column]:
    """Named text columns from an array of cells; short rows have empty cells."""
    return [F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]


def cells_from_map(values: Column, columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.try_element_at(values, F.lit(c)), F.lit("")) for c in columns])
