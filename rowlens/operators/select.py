"""Selections: ordered sets of row numbers, small or as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.spec import SELECTION_ROWS


class Selection:
    """An ordered set of row numbers and an optional choice of columns."""

    def __init__(self, cap: int = SELECTION_ROWS):
        self.cap, self._rows, self.columns = cap, {}, None

    def add(self, n: int) -> bool | None:
        """True if added, False if it was there, None if the set is full."""
        if n in self._rows:
            return False
        if self.full():
            return None
        self._rows[n] = None
        return True

    def remove(self, n: int) -> bool:
        return self._rows.pop(n, 0) is None

    def toggle(self, n: int) -> bool | None:
        return False if self.remove(n) else self.add(n)

    def add_all(self, numbers) -> tuple[int, bool]:
        """(added, whether the cap stopped it)."""
        added = 0
        for n in numbers:
            got = self.add(n)
            if got is None:
                return added, True
            added += bool(got)
        return added, False

    def clear(self) -> None:
        self._rows.clear()

    def full(self) -> bool:
        return len(self._rows) >= self.cap

    def rows(self) -> list[int]:
        return list(self._rows)

    def in_source_order(self) -> list[int]:
        return sorted(self._rows)

    def choose(self, columns: list[int] | None) -> None:
        if columns is not None and not columns:
            raise ValueError("at least one column must be chosen")
        self.columns = columns

    def __contains__(self, n) -> bool:
        return n in self._rows

    def __len__(self) -> int:
        return len(self._rows)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self._rows)), "sel_pos long, row_no long")


def add_bulk(current: DataFrame, more: DataFrame, cap: int = SELECTION_ROWS) -> DataFrame:
    """(sel_pos, row_no): current, then the new rows of more in its order, cap at most."""
    held = current.agg(F.count("*").alias("n"), F.max("sel_pos").alias("last")).first()
    new = more.groupBy("row_no").agg(F.min("sel_pos").alias("at")).join(current, "row_no", "left_anti")
    taken = new.orderBy("at").limit(max(0, cap - held["n"]))
    from pyspark.sql import Window

    base = -1 if held["last"] is None else held["last"]
    numbered = taken.select((F.row_number().over(Window.orderBy("at")) + base).cast("long").alias("sel_pos"), "row_no")
    return current.select("sel_pos", "row_no").unionByName(numbered)


def select_range(spark, start: int, end: int) -> DataFrame:
    """A page's row numbers as a table, without reading values."""
    return spark.range(start, end).select((F.col("id") - start).alias("sel_pos"), F.col("id").alias("row_no"))


def selected(rows: DataFrame, selection: DataFrame, columns: list[str] | None = None, row_no: str = "row_no") -> DataFrame:
    """The selected rows in selection order; numbers without a row are left out."""
    got = rows.join(selection.withColumnRenamed("row_no", row_no), row_no)
    return (got if columns is None else got.select("sel_pos", row_no, *columns)).orderBy("sel_pos")
