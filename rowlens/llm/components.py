"""Connected components by alternating large-star and small-star rounds.

Every round is a pair of grouped minima and joins on the edge table; no list
of a node's neighbours is ever gathered. A node that holds a large share of
the edges meets a table with one row for each node, so adaptive execution can
split its partition. Edges are dealt to as many partitions as their number
asks for: a small graph takes its rounds in one task, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import discard, few, stored


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge joins to another one.

    component is the smallest node reachable. Loops, repeated edges and null
    ends are ignored; no edges give an empty table.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = stored(e.where("x != y").select("u", "v").distinct(), "component-edges")
    n = e.count()
    seen = _mark(e)
    while seen[0]:
        table, e = e, few(e, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both, n).groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = few(both, n).join(few(least, n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = few(large, n).groupBy("u").agg(F.min("v").alias("m"))
        small = few(large, n).join(few(low, n), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(few(few(small.unionByName(low.select("u", F.col("m").alias("v"))), n).distinct(), n), "component-edges")
        discard(table)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").cast(kind).alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
