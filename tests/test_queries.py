"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from rowlens.operators import search
from rowlens.plans import registry
from rowlens.spec import SearchSpec


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf, duck, as_rows):
    got = as_rows(entry.queries()[name](spark, sf).toPandas())
    assert got == as_rows(duck.sql(registry.ORACLES[name]).df())


def test_entry(spark, sf):
    out = entry.entry(spark)
    assert out.columns == ["view_pos", "row_no", "sort_key"] or "row_no" in out.columns
    assert out.count() == 10


def test_top_k_is_a_take_ordered(spark, sf):
    plan = registry.topk_orders_desc(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_window_reaches_the_scan(spark, sf):
    plan = registry.window_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,500)" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_hits_and_lists_of_any_length_are_numbered_in_all_partitions(spark, sf):
    hits = search.search_hits(spark.range(20_000).repartition(3).selectExpr("id as row_no", "'aXa' as raw"), SearchSpec("a", limit=30_001))
    got = hits.orderBy("hit_no").collect()
    assert [(r.hit_no, r.row_no, r.position) for r in got] == [(i, i // 2, i % 2 * 2) for i in range(30_001)]
    for view in (hits, registry.list_sort_hits(spark, sf)):
        plan = view._jdf.queryExecution().toString()
        assert "rangepartitioning" in plan and "Window" not in plan and "TakeOrdered" not in plan
