"""Nested records to flat columns: dotted paths, first-seen order, collisions.

A record is JSON text. Flattening keeps lists and empty objects as leaves. A
path that a record lacks stays apart from a null in it: values() is a map with
no entry for the first and the text null for the second.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def leaves(record):
    """(dotted name, path as JSON, value as JSON) of every leaf, in document order."""
    def walk(v, path):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                yield from walk(x, (*path, k))
        else:
            yield {"name": ".".join(path), "path": json.dumps(path, ensure_ascii=False), "value": json.dumps(v, ensure_ascii=False)}

    return [] if record == {} else list(walk(record, ()))


@F.pandas_udf(LEAVES)
def _leaves(records: pd.Series) -> pd.Series:
    return records.map(lambda s: None if s is None else leaves(json.loads(s)))


def flatten(rows: DataFrame, record: str = "record", row_id: str = "row_id") -> DataFrame:
    """(row_id, pos, name, path, value): one row for each leaf; value is JSON text."""
    each = rows.select(F.col(row_id).alias("row_id"), F.posexplode(_leaves(F.col(record))).alias("pos", "leaf"))
    return each.select("row_id", "pos", "leaf.name", "leaf.path", "leaf.value")


def columns(flat: DataFrame) -> DataFrame:
    """(position, name): all names in the order in which they are first seen."""
    first = flat.groupBy("name").agg(F.min(F.struct("row_id", "pos")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("position"), "name")


def collisions(flat: DataFrame) -> DataFrame:
    """(name, paths): dotted names that stand for more than one path."""
    return flat.groupBy("name").agg(F.count_distinct("path").alias("paths")).where("paths > 1")


def check_collisions(flat: DataFrame) -> None:
    found = collisions(flat).limit(1).collect()
    if found:
        raise ValueError(f"column {found[0]['name']} stands for different paths")


def values(flat: DataFrame) -> DataFrame:
    """(row_id, values map<name, JSON text>): absent names have no entry. A record's own leaves only meet."""
    return flat.groupBy("row_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("values"))


def table(flat: DataFrame, names: list[str]) -> DataFrame:
    """(row_id, present, one text column for each name): absent and null are null,
    told apart by present."""
    v = values(flat)
    return v.select("row_id", F.map_keys("values").alias("present"), *[F.nullif(F.try_element_at("values", F.lit(n)), F.lit("null")).alias(n) for n in names])
