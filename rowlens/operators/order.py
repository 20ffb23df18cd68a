"""Sorts: bounded top-k, page and list sorts, and the full mixed-type sort.

All return view_pos, the place in the view, beside row_no. Views are ordinary
DataFrames; going back to source order is dropping the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.spec import KEY_BYTES, PAGE_SORT_ROWS, TOP_K_ROWS, SortSpec

#: A decimal number as the text rules take it: digits with single underscores
#: between them, a point, an exponent.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def _plain(s: Column) -> Column:
    number = F.when(s.rlike(NUMBER), F.expr("double(1)") * F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return number.when(s.rlike(INFINITE), F.when(F.startswith(s, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def number_key(text: Column) -> Column:
    """A number from text, with a point or in Turkish spelling; null if unreadable."""
    s = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    turkish = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(_plain(s), _plain(turkish))


def sort_key(spec: SortSpec) -> Column:
    return number_key(F.col(spec.key).cast("string")) if spec.kind == "number" else F.col(spec.key).cast("string")


def _directed(name: str, descending: bool) -> Column:
    return F.desc(name) if descending else F.asc(name)


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """view_pos for a bounded view (at most 250,000 rows by the checks of top_k and sort_page)."""
    return rows.withColumn("view_pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def top_k(rows: DataFrame, spec: SortSpec, k: int, row_no: str = "row_no") -> DataFrame:
    """(view_pos, row_no, sort_key) of the k first rows; unreadable keys are left out.

    At the boundary the larger row number wins; rows shown in a tie are in row
    order. Planned as TakeOrderedAndProject, so no more than k rows of a
    partition move.
    """
    if not 1 <= k <= TOP_K_ROWS:
        raise ValueError(f"k must be from 1 to {TOP_K_ROWS}")
    keyed = rows.select(F.col(row_no).alias("row_no"), sort_key(spec).alias("sort_key")).where("sort_key is not null")
    best = keyed.orderBy(_directed("sort_key", spec.descending), F.desc("row_no")).limit(k)
    return _numbered(best, _directed("sort_key", spec.descending), "row_no").select("view_pos", "row_no", "sort_key")


def unreadable(rows: DataFrame, spec: SortSpec) -> DataFrame:
    """One row: rows examined and rows whose key can't be read."""
    key = sort_key(spec)
    return rows.agg(F.count("*").alias("examined"), F.count_if(key.isNull()).alias("excluded"))


def top_k_report(rows: DataFrame, spec: SortSpec, k: int, raw: str) -> DataFrame:
    """One row about a top-k: rows and bytes examined, rows whose key can't be read, rows shown, and whether k cut some off."""
    key = sort_key(spec)
    readable = F.count(key)
    return rows.agg(
        F.count("*").alias("examined"), F.coalesce(F.sum(F.octet_length(raw).cast("long")), F.lit(0)).alias("bytes"), F.count_if(key.isNull()).alias("excluded"),
        F.least(readable, F.lit(k)).cast("long").alias("shown"), (readable > k).alias("cut"),
    )


def sort_page(rows: DataFrame, spec: SortSpec, start: int, count: int, row_no: str = "row_no") -> DataFrame:
    """A stable sort of the rows [start, start + count)."""
    if count < 1 or start < 0:
        raise ValueError("a page has a start of 0 or more and at least one row")
    if count > PAGE_SORT_ROWS:
        raise ValueError(f"a page sort takes {PAGE_SORT_ROWS} rows at most")
    page = rows.where(F.col(row_no).between(start, start + count - 1))
    keyed = page.select(F.col(row_no).alias("row_no"), sort_key(spec).alias("sort_key")).where("sort_key is not null")
    return _numbered(keyed, _directed("sort_key", spec.descending), "row_no").select("view_pos", "row_no", "sort_key")


def sort_list(rows: DataFrame, spec: SortSpec, wanted: DataFrame, row_no: str = "row_no") -> DataFrame:
    """A stable sort of given rows (input_pos, row_no); repeated numbers stay repeated.

    The list may be as long as the table, so it is range-sorted.
    """
    keyed = rows.select(F.col(row_no).alias("row_no"), sort_key(spec).alias("sort_key"))
    found = wanted.select("input_pos", "row_no").join(keyed, "row_no").where("sort_key is not null")
    return sorted_view(found.orderBy(_directed("sort_key", spec.descending), "input_pos"), "view_pos").select("view_pos", "row_no", "sort_key")


def mixed_keys(json: Column) -> list[Column]:
    """Sort columns of a JSON text: rank, boolean, number, text.

    Ranks: boolean 0, number 1, text 2, list or object 3; null, NaN and absent
    values have rank null. Lists and objects compare by their JSON text.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    rank = (
        F.when(v.isNull() | (kind == "VOID"), None).when(kind == "BOOLEAN", 0)
        .when(number & ~F.isnan(F.try_variant_get(v, "$", "double")), 1).when(number, None).when(kind == "STRING", 2).otherwise(3)
    )
    get = lambda t: F.try_variant_get(v, "$", t)
    return [
        rank.cast("int").alias("rank"),
        F.when(rank == 0, get("boolean")).alias("bool_key"),
        F.when(rank == 1, get("double")).alias("double_key"),
        F.when(rank == 1, get("decimal(38,0)")).alias("whole_key"),
        F.when(rank == 1, get("decimal(38,18)")).alias("exact_key"),
        F.when(rank == 2, get("string")).when(rank == 3, F.to_json(v)).alias("text_key"),
    ]


def sort_mixed(rows: DataFrame, json: str, descending: bool = False, view_pos: str = "view_pos", max_key: int = KEY_BYTES) -> DataFrame:
    """The full stable sort over values of any type, as ordered rows.

    The order of ranks does not turn with the direction, and rows without a
    value come last in both. Ties keep the order of the current view. A key
    beyond max_key bytes is an error. The result is range-sorted over all
    partitions; sorted_view() numbers it.
    """
    keys = mixed_keys(F.col(json))
    names = ["rank", "bool_key", "double_key", "whole_key", "exact_key", "text_key"]
    checked = F.when(F.octet_length(F.col(json).cast("string")) > max_key, F.raise_error(F.lit("a sort key is too large")).cast("string")).otherwise(F.col(json))
    k = rows.withColumn("_json", checked).select("*", *mixed_keys(F.col("_json"))).drop("_json") if keys else rows
    order = [F.asc_nulls_last("rank"), *[_directed(c, descending) for c in names[1:]], F.asc(view_pos)]
    return k.orderBy(*order).drop(*names)


def sorted_view(ordered: DataFrame, name: str = "new_pos", keep: bool = True) -> DataFrame:
    """Numbers an ordered DataFrame: counts of its partitions, then their sums.

    Every partition is numbered on its own; one row for each comes to the
    driver. keep=False if what it is made from is persisted already.
    """
    spark = ordered.sparkSession
    marked = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    marked = marked.persist() if keep else marked
    counts = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())
    bases, base = [], 0
    for part, n in counts:
        bases.append((part, base))
        base += n
    table = spark.createDataFrame(bases or [(0, 0)], "_part int, _base long")
    local = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    return marked.join(F.broadcast(table), "_part").withColumn(name, F.col("_base") + local).drop("_part", "_base", "_id")
