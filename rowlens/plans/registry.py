"""Queries of the record-inspection engine over the driver's tables, with their SQL.

A table's key column serves as row number. Queries over files and documents are
in rowlens.plans.documents, those over views and selections in rowlens.plans.views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.functions import b64, text
from rowlens.operators import navigate, normalize, order, search, select
from rowlens.plans import base, documents, views  # noqa: F401  their queries register themselves
from rowlens.plans.base import ORACLES, QUERIES  # noqa: F401  the driver's entry reads them here
from rowlens.plans.base import query as _query
from rowlens.plans.base import table as _table
from rowlens.sources import export
from rowlens.spec import B64Spec, SearchSpec, SortSpec


def flagship(spark, sf_dir):
    """The ten largest orders, with view position and row number."""
    rows = _table(spark, sf_dir, "orders")
    return order.top_k(rows, SortSpec("o_totalprice", True, "number"), 10, "o_orderkey")


# --- sorts -----------------------------------------------------------------


@_query("""
with t as (select o_orderkey as row_no, o_totalprice as sort_key from orders order by o_totalprice desc, o_orderkey desc limit 1000)
select row_number() over (order by sort_key desc, row_no) - 1 as view_pos, row_no, sort_key from t
""")
def topk_orders_desc(spark, sf_dir):
    return order.top_k(_table(spark, sf_dir, "orders"), SortSpec("o_totalprice", True, "number"), 1000, "o_orderkey")


@_query("""
with t as (select p_partkey as row_no, p_name as sort_key from part order by p_name, p_partkey desc limit 500)
select row_number() over (order by sort_key, row_no) - 1 as view_pos, row_no, sort_key from t
""")
def topk_text_asc(spark, sf_dir):
    return order.top_k(_table(spark, sf_dir, "part"), SortSpec("p_name"), 500, "p_partkey")


@_query("""
with t as (select o_orderkey as row_no, o_orderstatus as sort_key from orders order by o_orderstatus desc, o_orderkey desc limit 777)
select row_number() over (order by sort_key desc, row_no) - 1 as view_pos, row_no, sort_key from t
""")
def topk_ties_desc(spark, sf_dir):
    """A key with three values: the limit falls inside a tie."""
    return order.top_k(_table(spark, sf_dir, "orders"), SortSpec("o_orderstatus", True), 777, "o_orderkey")


@_query("""
select row_number() over (order by value desc, event_id) - 1 as view_pos, event_id as row_no, value as sort_key from events where event_id between 100 and 1099
""")
def page_sort_events(spark, sf_dir):
    return order.sort_page(_table(spark, sf_dir, "events"), SortSpec("value", True, "number"), 100, 1000, "event_id")


@_query("""
with h as (select doc_id as row_no, generate_series as k from documents, generate_series(1, ((length(text) - length(replace(text, 'the', ''))) // 3)::bigint)),
i as (select row_no, row_number() over (order by row_no, k) - 1 as input_pos from h)
select row_number() over (order by d.source, i.input_pos) - 1 as view_pos, i.row_no, d.source as sort_key from i join documents d on d.doc_id = i.row_no
""")
def list_sort_hits(spark, sf_dir):
    """Hits of a search sorted by another column, one row for each occurrence."""
    docs = _table(spark, sf_dir, "documents")
    hits = search.search_positions(docs, SearchSpec("the", case=True), "doc_id", "text")
    hits = order.sorted_view(hits.repartitionByRange("row_no", "position").sortWithinPartitions("row_no", "position").select("row_no"), "input_pos")
    return order.sort_list(docs, SortSpec("source"), hits, "doc_id")


_SPELT = {
    0: ("cast(event_id as string)", "event_id::varchar"), 1: ("concat(' ', event_id, ',5 ')", "' ' || event_id || ',5 '"),
    2: ("concat(event_id, '.234,56')", "event_id || '.234,56'"), 3: ("concat(event_id, 'd')", "event_id || 'd'"),
    4: ("concat(event_id, '_000')", "event_id || '_000'"), 5: ("'nan'", "'nan'"), 6: ("''", "''"),
}


def _spelt(which: int) -> str:
    return "case event_id % 7 " + " ".join(f"when {k} then {v[which]}" for k, v in _SPELT.items()) + " end"


@_query("""
with n as (select event_id, case event_id % 7 when 0 then event_id::double when 1 then event_id + 0.5 when 2 then (event_id || '234.56')::double
  when 4 then event_id * 1000.0::double end as sort_key from events),
t as (select event_id as row_no, sort_key from n where sort_key is not null order by sort_key, event_id desc limit 2000)
select row_number() over (order by sort_key, row_no) - 1 as view_pos, row_no, sort_key from t
""")
def topk_number_text(spark, sf_dir):
    """Numbers in point, Turkish and underscore spelling, among text that is none."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_spelt(0)).alias("spelt"))
    return order.top_k(rows, SortSpec("spelt", False, "number"), 2000, "event_id")


@_query("select count(*) as examined, count(*) filter (event_id % 7 in (3, 5, 6)) as excluded from events")
def unreadable_keys(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_spelt(0)).alias("spelt"))
    return order.unreadable(rows, SortSpec("spelt", False, "number"))


_MIXED = """case event_id % 6 when 0 then case when event_id % 4 = 0 then 'true' else 'false' end when 1 then cast(event_id % 1000 as {s})
 when 2 then concat('"', event_type, '"') when 3 then concat('[', cast(event_id % 10 as {s}), ']') when 4 then 'null' end"""


def _mixed_sql(descending: bool) -> str:
    d = "desc" if descending else "asc"
    return f"""
with m as (select event_id, event_type, case event_id % 6 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 end as rank from events)
select event_id as row_no, row_number() over (order by rank nulls last, case when rank = 0 then event_id % 4 = 0 end {d}, case when rank = 1 then event_id % 1000 end {d},
  case when rank = 2 then event_type when rank = 3 then '[' || (event_id % 10) || ']' end {d}, event_id) - 1 as view_pos from m
"""


def _mixed(spark, sf_dir, descending):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("row_no"), F.expr(_MIXED.format(s="string")).alias("json"))
    return order.sorted_view(order.sort_mixed(rows, "json", descending, "row_no"), "view_pos").select("row_no", "view_pos")


@_query(_mixed_sql(False))
def mixed_sort_asc(spark, sf_dir):
    """The full stable sort over booleans, numbers, texts, lists, nulls and absent values."""
    return _mixed(spark, sf_dir, False)


@_query(_mixed_sql(True))
def mixed_sort_desc(spark, sf_dir):
    return _mixed(spark, sf_dir, True)


# --- search ----------------------------------------------------------------


@_query("select doc_id from documents where contains(text, 'the')")
def search_literal_docs(spark, sf_dir):
    return search.search_rows(_table(spark, sf_dir, "documents"), SearchSpec("the", case=True), "text").select("doc_id")


@_query("""
select doc_id as row_no, ((length(text) - length(replace(text, 'the', ''))) // 3)::bigint as hits from documents where contains(text, 'the')
""")
def search_occurrences(spark, sf_dir):
    return search.search_counts(_table(spark, sf_dir, "documents"), SearchSpec("the", case=True), "doc_id", "text")


@_query("""
with t as (select translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select count(*) as rows, sum((length(x) - length(replace(x, 'the', ''))) // 3)::bigint as hits from t where contains(x, 'the')
""")
def search_total_fold(spark, sf_dir):
    """Rows and occurrences with A-Z folded, uncapped."""
    return search.search_total(_table(spark, sf_dir, "documents"), SearchSpec("The"), "text")


@_query("""
with h as (select doc_id, unnest(range(1, length(text) - 2)) as i, text from documents where contains(text, 'haha')), o as (select doc_id, i, text from h where substr(text, i, 4) = 'haha'),
t as (select doc_id, octet_length(encode(substr(text, 1, i - 1))) as position from o order by 1, 2 limit 5000)
select row_number() over (order by doc_id, position) - 1 as hit_no, doc_id as row_no, position::bigint as position from t
""")
def search_hits_overlapping(spark, sf_dir):
    """Byte positions of overlapping occurrences, the first 5,000."""
    return search.search_hits(_table(spark, sf_dir, "documents"), SearchSpec("haha", case=True), "doc_id", "text").select("hit_no", "row_no", "position")


@_query("""
select doc_id from documents where contains(text, 'èai') or contains(text, 'ÈAI') or contains(text, 'Èai') or contains(text, 'ÈAİ')
""")
def search_turkish_fold(spark, sf_dir):
    """A query beyond ASCII: its spellings, the Turkish ones included."""
    return search.search_rows(_table(spark, sf_dir, "documents"), SearchSpec("èai"), "text").select("doc_id")


@_query("select doc_id as row_no, len(regexp_extract_all(text, '[Tt]h[aeiou]+nd'))::bigint as hits from documents where regexp_matches(text, '[Tt]h[aeiou]+nd')")
def search_regex(spark, sf_dir):
    return search.search_counts(_table(spark, sf_dir, "documents"), SearchSpec("[Tt]h[aeiou]+nd", case=True, regex=True), "doc_id", "text")


@_query("select c_custkey as row_no from customer where contains(c_name, '7') or contains(c_mktsegment, '7') or contains(c_nationkey::varchar, '7')")
def search_cells(spark, sf_dir):
    return search.search_cells(_table(spark, sf_dir, "customer"), "7", ["c_name", "c_mktsegment", "c_nationkey"], "c_custkey").select(F.col("c_custkey").alias("row_no"))


@_query("""
select row_number() over (order by event_id) - 1 as hit_no, event_id as view_pos, event_id as row_id from events where contains(event_type, 'cl') or contains(props, 'cl')
""")
def search_store(spark, sf_dir):
    """The store search: raw JSON first where that is safe, then the values."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("view_pos"), F.col("event_id").alias("row_id"), F.array("event_type", "props").alias("values"), F.to_json(F.struct("event_type", "props")).alias("raw"))
    return search.search_store(rows, "cl", "values", "raw")


# --- navigation and selection ----------------------------------------------


@_query("select event_id, event_type, value from events where event_id between 500 and 749")
def window_rows(spark, sf_dir):
    return navigate.window_rows(_table(spark, sf_dir, "events"), 500, 250, "event_id").select("event_id", "event_type", "value")


@_query("select event_id, event_type, (777 // 100)::bigint as page from events where event_id = 777")
def goto_row(spark, sf_dir):
    return navigate.go_to(_table(spark, sf_dir, "events"), 777, page_rows=100, row_no="event_id").select("event_id", "event_type", "page")


@_query("select count(*) as total, greatest(1, (count(*) + 99999) // 100000)::bigint as pages from lineitem")
def page_count(spark, sf_dir):
    return navigate.page_count(_table(spark, sf_dir, "lineitem"))


_IDS = [9, 3, 3, 700, 42, 10**9, 0]


@_query("select s.i as fetch_pos, e.event_id, e.value from (values (0, 9), (1, 3), (2, 3), (3, 700), (4, 42), (5, 1000000000), (6, 0)) s(i, id) join events e on e.event_id = s.id")
def scatter_fetch(spark, sf_dir):
    """Rows in a given order; repeated numbers repeat, missing ones are left out."""
    return navigate.fetch(_table(spark, sf_dir, "events"), _IDS, "event_id").select("fetch_pos", "event_id", "value")


@_query("""
with v as (select o_orderkey as row_no, row_number() over (order by o_totalprice, o_orderkey) - 1 as view_pos from orders)
select view_pos, row_no from v where view_pos between 500 and 999
""")
def legacy_page(spark, sf_dir):
    """Page 1 of 500 rows of a full sort."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_totalprice").cast("string").alias("json"))
    view = order.sorted_view(order.sort_mixed(rows, "json", view_pos="row_no"), "view_pos").select("view_pos", "row_no")
    return navigate.legacy_page(view, 1, rows.count())


@_query("select 0::bigint as position, 'k' as name")
def first_seen_columns(spark, sf_dir):
    return navigate.first_seen_columns(_table(spark, sf_dir, "events"), "props", "event_id")


@_query("select doc_id, len(string_split(text, ',')) <> 12 as mismatched, array_to_string(list_resize(string_split(text, ','), 12, ''), '|') as shown from documents")
def width_check(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", ",", -1).alias("cells"))
    return rows.select("doc_id", *navigate.width_check(F.col("cells"), 12)).withColumn("shown", F.array_join("shown", "|"))


@_query("""
select (row_number() over (order by sel_pos) - 1)::bigint as sel_pos, row_no from (
  select i as sel_pos, 3 * i as row_no from range(100) t(i) union all
  select 1000 + p, r from (select min(i) as p, i % 500 as r from range(900) t(i) group by i % 500) where r % 3 <> 0 or r >= 300
) order by 1 limit 400
""")
def select_bulk_cap(spark, sf_dir):
    """Adding to a selection: no repeats, in order, up to a cap."""
    current = spark.range(100).select(F.col("id").alias("sel_pos"), (3 * F.col("id")).alias("row_no"))
    more = spark.range(900).select(F.col("id").alias("sel_pos"), (F.col("id") % 500).alias("row_no"))
    return select.add_bulk(current, more, 400)


@_query("select c_custkey - 50 as sel_pos, c_custkey, c_name from customer where c_custkey between 50 and 149")
def selected_page(spark, sf_dir):
    return select.selected(_table(spark, sf_dir, "customer"), select.select_range(spark, 50, 150), ["c_name"], "c_custkey")


# --- Base64 ----------------------------------------------------------------


def _encoded(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.base64(F.col("c_name").cast("binary")).alias("e"))


@_query("select c_custkey, c_name as text, 'utf-8' as encoding from customer")
def b64_roundtrip(spark, sf_dir):
    """Padding taken off and white space put in, then decoded to text."""
    rows = _encoded(spark, sf_dir).select("c_custkey", F.array(F.concat(F.left("e", F.lit(4)), F.lit(" \n"), F.rtrim(F.substring("e", 5, 1 << 30), F.lit("=")))).alias("cells"))
    raw = b64.decode(b64.extract(F.col("cells"), B64Spec((0,))))
    return rows.select("c_custkey", b64.bytes_to_text(raw).alias("t")).select("c_custkey", "t.text", "t.encoding")


@_query("select c_custkey, c_name as text from customer")
def b64_marker_parts(spark, sf_dir):
    """A payload over three cells, each behind a marker that occurs twice."""
    cut = [F.substring("e", 1, 7), F.substring("e", 8, 5), F.substring("e", 13, 1 << 30)]
    cells = [F.concat(F.col("c_custkey").cast("string"), F.lit(f"_½_{i}_½_"), c) for i, c in enumerate(cut)]
    spec = B64Spec((0, 1, 2), prefix="_½_", prefix_mode="marker", last_marker=True, per_part=True)
    rows = _encoded(spark, sf_dir).select("c_custkey", F.array(*cells).alias("cells"))
    return rows.select("c_custkey", b64.utf8_text(b64.decode(b64.extract(F.col("cells"), spec))).alias("text"))


@_query("select c_custkey, case when c_custkey % 5 in (0, 4) then c_name end as text, case c_custkey % 5 when 1 then 'alphabet' when 2 then 'length' when 3 then 'missing' end as problem from customer")
def b64_problems(spark, sf_dir):
    """What keeps a field from being decoded."""
    e = F.concat(F.lit("key:"), F.col("e"), F.lit(";"))
    cell = F.expr("case c_custkey % 5 when 1 then 'key:!!!!;' when 2 then 'key:QUJDR;' when 3 then 'QUJD' end")
    spec = B64Spec((0,), prefix="key:", prefix_mode="start", suffix=";")
    rows = _encoded(spark, sf_dir).select("c_custkey", F.array(F.coalesce(cell, e)).alias("cells")).withColumn("b", b64.extract(F.col("cells"), spec))
    return rows.select("c_custkey", b64.utf8_text(b64.decode(F.col("b"))).alias("text"), b64.problem(F.col("b")).alias("problem"))


@_query("select c_custkey, case when c_custkey % 2 = 0 then c_name end as text from customer")
def b64_strict(spark, sf_dir):
    """Strict decoding takes no white space and no missing padding."""
    rows = _encoded(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("e")).otherwise(F.concat(F.lit(" "), "e")).alias("e"))
    return rows.select("c_custkey", b64.utf8_text(b64.decode_strict(F.col("e"))).alias("text"))


@_query("select n_nationkey, case n_nationkey % 4 when 0 then 'PDF' when 1 then 'GZIP' when 2 then 'GIF' end as file_type from nation")
def b64_file_type(spark, sf_dir):
    raw = F.expr("case n_nationkey % 4 when 0 then X'255044462D312E37' when 1 then X'1F8B0800' when 2 then cast('GIF89a..' as binary) else cast(n_name as binary) end")
    return _table(spark, sf_dir, "nation").select("n_nationkey", b64.file_type(raw).alias("file_type"))


@_query("select c_custkey, '_½_' as marker, c_name as text from customer")
def b64_suggest(spark, sf_dir):
    """A configuration found from the cells alone."""
    cells = F.array(*[F.concat(F.col("c_custkey").cast("string"), F.lit(f"_{i}_½_"), F.substring("e", a, n)) for i, (a, n) in enumerate(((1, 8), (9, 8), (17, 1 << 30)))])
    rows = _encoded(spark, sf_dir).select("c_custkey", b64.suggest_struct(cells).alias("s"))
    return rows.select("c_custkey", "s.marker", "s.text")


# --- values, nested records, reports ---------------------------------------


@_query("select event_id, case when k is null then '' else k end as text from (select event_id, json_extract_string(props, '$.k') as k from events)")
def json_value_text(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.json_as_text(F.to_json(F.try_variant_get(F.parse_json("props"), "$.k", "variant"))).alias("text"))


@_query("select event_id as row_id, 'props.k' as name, json_extract(props, '$.k')::varchar as value from events union all select event_id, 'type', '\"' || event_type || '\"' from events")
def flatten_records(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("record"))
    return normalize.flatten(rows).select("row_id", "name", "value")


@_query("select 0::bigint as position, 'type' as name union all select 1, 'props.k' union all select 2, 'late'")
def record_columns(spark, sf_dir):
    """Columns in first-seen order, over all records."""
    late = F.when(F.col("event_id") >= 50, ',"late":{}}').otherwise("}")
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", late).alias("record"))
    return normalize.columns(normalize.flatten(rows))


@_query("select 'a.b' as name, 2::bigint as paths")
def column_collisions(spark, sf_dir):
    record = F.when(F.col("n_nationkey") < 3, '{"a":{"b":1}}').otherwise('{"a.b":1,"c":2}')
    return normalize.collisions(normalize.flatten(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), record.alias("record"))))


@_query("select o_orderkey, replace(format('{:,}', (o_totalprice * 1000)::bigint), ',', '.') as number from orders")
def grouped_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.grouped(F.round(F.col("o_totalprice") * 1000).cast("long")).alias("number"))


@_query("select c_custkey, c_custkey || e'\\t' || c_name || e'\\t' || c_mktsegment as line from customer")
def tsv_lines(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", export.tsv_line(["c_custkey", "c_name", "c_mktsegment"]).alias("line"))
