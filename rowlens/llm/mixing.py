"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are put in a random but fixed order (a digest of seed, id
and text). A document's virtual finish time is the number of words its source
has sent up to its end, divided by the source's target; a second pass over a
source goes on from its size. Sending all documents in the order of their
finish times and stopping when the budget is spent brings every source near
its target at once.

Targets share the budget by weight; a target stops at `most` passes over its
source and what it leaves is shared by weight among the others. Running sums
are taken in two levels (a total for each source and slice of the order, then
within the slice), so that no source is one task; the cut is found from a
histogram of finish times. One row for each source comes to the driver.

A null text has size 0, a null source is one source and comes last; sources
without words have target 0. Documents of size 0 take 0 words. Null or equal
ids and repeated rows are separate documents; the text's digest keeps those of
one id apart in the order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import stored, table, word_count

#: Bins of the histogram of finish times, and slices of a source at least.
SLICES = 1024
SLICE_ROWS = 100_000
#: Finish times in the last slice that is sorted to find the cut.
CUT_ROWS = 10_000


def targets(sizes: dict, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> dict:
    """source -> target words. Sources by code point, null last, take the weights in turn."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), list(order)
    out = {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > most * sizes[s] * whole]
        if not full:
            out.update({s: left * weight[s] / whole for s in open_})
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _cut(events: DataFrame, budget: float):
    """The last event (by v, pass, r, id, size) within the budget, as a row, or None."""
    low, high, before = 0.0, None, 0
    while True:
        inside = events.where(F.col("v") >= low) if high is None else events.where((F.col("v") >= low) & (F.col("v") < high))
        n, top = inside.agg(F.count("*"), F.max("v")).first()
        if not n or n <= CUT_ROWS or top <= low or (high is not None and high - low < 1e-12):
            break
        width = (top - low) / SLICES
        bins = inside.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(SLICES - 1)).alias("k")).agg(F.sum("size").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        chosen = None
        for row in bins.orderBy("k").collect():  # SLICES rows at most
            if before + row.n > budget:
                chosen = row
                break
            before += row.n
        if chosen is None:
            return inside.orderBy(F.desc("v"), F.desc("pass"), F.desc_nulls_last("r"), F.desc_nulls_last("id"), F.desc("size")).first()
        if (chosen.a, chosen.b) == (low, top):
            break
        low, high = chosen.a, _after(chosen.b)
    w = Window.orderBy("v", "pass", "r", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    kept = inside.withColumn("total", F.sum("size").over(w) + before).where(F.col("total") <= budget)
    last = kept.orderBy(F.desc("total"), F.desc("v"), F.desc("pass"), F.desc_nulls_last("r"), F.desc_nulls_last("id")).first()
    if last is None and low > 0:
        below = events.where(F.col("v") < low)
        last = below.orderBy(F.desc("v"), F.desc("pass"), F.desc_nulls_last("r"), F.desc_nulls_last("id"), F.desc("size")).first()
    return last


def _after(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source, source_size, target, taken) of every document.

    taken: words of it in the mix, size times the passes that take it.
    """
    spark = docs.sparkSession
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    r = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), r.alias("r")), "mix-sizes")
    sizes = {x.source: x.n for x in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, weights, share, most)
    plan = spark.createDataFrame([(s, n, float(target[s])) for s, n in sizes.items()], f"source string, source_size long, target double")
    bits = max(SLICES, rows.count() // SLICE_ROWS).bit_length() - 1
    rows = rows.withColumn("slice", F.shiftright("r", 60 - bits))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "slice", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    base = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b.slice", "b.base", "p.source_size", "p.target")
    inner = Window.partitionBy("source", "slice").orderBy("r", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("inner", F.sum("size").over(inner))
    cond = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.slice") == F.col("b.slice"))
    done = at.alias("a").join(base.alias("b"), cond).select("a.id", "a.source", "a.size", "a.r", (F.col("inner") + F.col("base")).alias("upto"), "source_size", "target")
    done = stored(done, "mix-order")
    passes = F.explode(F.array(*[F.lit(i) for i in range(most)]))
    finish = lambda k: (F.col("source_size") * k + F.col("upto")).cast("double") / F.col("target")
    events = done.where("size > 0 and target > 0").select("id", "r", "size", "upto", "source_size", "target", passes.alias("pass")).withColumn("v", finish(F.col("pass"))).select("id", "r", "size", "pass", "v")
    last = _cut(events, share * sum(sizes.values()))
    if last is None:
        return done.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # nulls come first in the order, as in the sort above
    key = lambda v, k, r, i, n: F.struct(v.alias("v"), k.cast("int").alias("k"), r.alias("r"), i.alias("i"), n.cast("long").alias("n"))
    id_type = docs.schema[id_col].dataType
    end = key(F.lit(last.v).cast("double"), F.lit(last["pass"]), F.lit(last.r).cast("long"), F.lit(last.id).cast(id_type), F.lit(last.size))
    took = sum(
        (F.when((F.col("size") > 0) & (F.col("target") > 0) & (key(finish(F.lit(k)), F.lit(k), F.col("r"), F.col("id"), F.col("size")) <= end), 1).otherwise(0) for k in range(most)),
        start=F.lit(0),
    )
    return done.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (F.col("size") * took).cast("long").alias("taken"))


def op1_mix_sources(spark, sf_dir) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as r
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight from s
), o as (
  select *, sum(weight) over (order by source_size / weight, source is null, source rows between current row and unbounded following) as w_left,
         coalesce(sum(2 * source_size) over (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as before
  from w
), capped as (
  select *, 4 * source_size * w_left < weight * (3 * (select sum(source_size) from s) - 2 * before) as full_ from o
), rest as (
  select 1.5::double * (select sum(source_size) from s)::double - coalesce(sum(2 * source_size) filter (full_), 0)::double as left_, sum(weight) filter (not full_) as whole from capped
), t as (
  select source, source_size, case when full_ then (2 * source_size)::double else left_ * weight::double / whole::double end as target from capped, rest
), u as (
  select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by r, doc_id, size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source
), e as (
  select doc_id, size, r, p, (source_size * p + upto)::double / target as v from u, (values (0), (1)) passes(p) where size > 0 and target > 0
), g as (
  select doc_id, r, size, sum(size) over (order by v, p, r, doc_id, size rows unbounded preceding) as total from e
), k as (
  select doc_id, r, size, count(*) as n from g where total <= 1.5 * (select sum(source_size) from s) group by all
)
select u.doc_id, u.size, u.source_size, u.target, (u.size * coalesce(k.n, 0))::bigint as taken
from u left join k on u.doc_id = k.doc_id and u.r = k.r and u.size = k.size
"""
