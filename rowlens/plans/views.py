"""Queries over views, selections, cells and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.functions import b64, text
from rowlens.operators import navigate, order, search
from rowlens.operators.select import Selection
from rowlens.plans.base import query, table
from rowlens.spec import SearchSpec, SortSpec

# --- views -----------------------------------------------------------------


@query("select c_custkey, case when c_custkey % 3 = 0 then '' else c_name end as c_name, c_mktsegment, c_custkey + 1 as shown from customer")
def visible_columns(spark, sf_dir):
    """A projection for show: nulls are empty, numbers count from one."""
    rows = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    shown = navigate.visible(rows, ["c_name", "c_mktsegment"], "c_custkey")
    return shown.withColumn("shown", navigate.shown_number(F.col("c_custkey").cast("long")))


_VIEW = """
with t as (select o_orderkey as row_no, o_totalprice as sort_key from orders order by o_totalprice desc, o_orderkey desc limit 1000),
v as (select row_number() over (order by sort_key desc, row_no) - 1 as view_pos, row_no from t)
"""


def _view(spark, sf_dir):
    return order.top_k(table(spark, sf_dir, "orders"), SortSpec("o_totalprice", True, "number"), 1000, "o_orderkey")


@query(_VIEW + "select view_pos, row_no from v where view_pos = 4")
def view_position(spark, sf_dir):
    """The row at the fifth place of a view."""
    return navigate.at_position(_view(spark, sf_dir), 5, 1000).select("view_pos", "row_no")


@query(_VIEW + "select v.view_pos from v join (select max(o_orderkey) as k from orders where o_totalprice = (select max(o_totalprice) from orders)) on row_no = k")
def position_of_row(spark, sf_dir):
    """The place of a given row in a view."""
    orders = table(spark, sf_dir, "orders")
    row = orders.agg(F.max(F.struct("o_totalprice", "o_orderkey")).alias("m")).first().m.o_orderkey
    return navigate.position_of(_view(spark, sf_dir), row)


@query(_VIEW + "select view_pos, row_no from v where view_pos between 100 and 149")
def view_page(spark, sf_dir):
    return navigate.view_page(_view(spark, sf_dir), 100, 50).select("view_pos", "row_no")


@query("select event_id as row_id, event_type from events where event_id = 321")
def record_by_id(spark, sf_dir):
    store = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type")
    return navigate.record_by_id(store, 321)


@query("select n_nationkey, case when n_nationkey % 2 = 0 then n_name end as named, n_nationkey % 2 = 0 as present, n_name as second, null::varchar as ninth from nation")
def cell_getter(spark, sf_dir):
    """Cells by name, where an absent one is no empty one, and by place."""
    rows = table(spark, sf_dir, "nation")
    held = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("n"), "n_name")).otherwise(F.create_map(F.lit("x"), F.lit("")))
    cells = F.array(F.lit("a"), "n_name")
    return rows.select("n_nationkey", navigate.cell(held, "n").alias("named"), F.map_contains_key(held, "n").alias("present"), navigate.positional_cell(cells, 1).alias("second"), navigate.positional_cell(cells, 8).alias("ninth"))


@query("select true as refused, count(*) as rows from nation")
def large_sort_key(spark, sf_dir):
    """A sort whose keys are longer than allowed, and the same with room for them."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_no"), F.to_json(F.struct("n_name")).alias("json"))
    try:
        order.sort_mixed(rows, "json", view_pos="row_no", max_key=5).collect()
        refused = False
    except Exception as e:  # noqa: BLE001  the job's error, by its message
        refused = "too large" in str(e)
    return spark.createDataFrame([(refused, order.sort_mixed(rows, "json", view_pos="row_no").count())], "refused boolean, rows long")


@query("select * from (values (0::bigint, 7::bigint), (1, 2), (2, 9), (3, 4)) t(sel_pos, row_no)")
def selection_steps(spark, sf_dir):
    """A selection of at most four rows after adding, toggling and adding many."""
    s = Selection(cap=4)
    steps = (s.add(7), s.add(3), s.add(7), s.toggle(3), s.toggle(2), s.add_all([9, 2, 4, 5]), s.add(6))
    return s.table(spark) if steps == (True, True, False, False, True, (2, True), None) else spark.range(0)


@query("select i as hit, (i + 1) % 7 as next, (i + 6) % 7 as previous from range(7) t(i)")
def hit_steps(spark, sf_dir):
    """The next and the previous hit, around the ends."""
    return spark.createDataFrame([(i, search.step(7, i), search.step(7, i, False)) for i in range(7)], "hit long, next long, previous long")


# --- search ----------------------------------------------------------------


@query("""
with h as (select c_custkey, unnest(range(1, length(c_name) + 1)) as i, c_name from customer), t as (select c_custkey, i, c_name from h where substr(c_name, i, 1) = '0' order by 1, 2 limit 100)
select row_number() over (order by c_custkey, i) - 1 as hit_no, c_custkey as row_no, (i - 1)::bigint as position, c_name as preview, false as cut from t
""")
def search_capped(spark, sf_dir):
    """The first hundred occurrences, with previews."""
    return search.search_hits(table(spark, sf_dir, "customer"), SearchSpec("0", case=True, limit=100), "c_custkey", "c_name")


@query("""
with h as (select doc_id, text, instr(text, 'the') as i from documents where instr(text, 'the') > 0), t as (select * from h order by doc_id limit 50),
c as (select doc_id, octet_length(encode(text)) > 600 as cut, text from t)
select doc_id as row_no, cut, case when cut then left(text, 200) else text end as preview from c
""")
def search_previews(spark, sf_dir):
    """The first occurrence of each of fifty rows; previews are cut at 600 bytes."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).orderBy("doc_id").limit(50)
    first = search.search_hits(docs, SearchSpec("the", case=True, limit=1 << 20), "doc_id", "text")
    first = first.groupBy("row_no").agg(F.min(F.struct("position", "cut", "preview")).alias("f"))
    return first.select("row_no", "f.cut", F.when(F.col("f.cut"), F.left("f.preview", F.lit(200))).otherwise(F.col("f.preview")).alias("preview"))


@query("""
with h as (select n_nationkey, n_name || chr(0) || 'xAN' || chr(1) || n_name as x from nation), o as (select n_nationkey, x, unnest(range(1, length(x))) as i from h)
select row_number() over (order by n_nationkey, i) - 1 as hit_no, n_nationkey as row_no, (i - 1)::bigint as position from o where regexp_full_match(substr(x, i, 2), 'A[A-N]')
""")
def search_regex_hits(spark, sf_dir):
    """Byte positions of a pattern's matches in texts that hold control characters."""
    x = F.concat("n_name", F.char(F.lit(0)), F.lit("xAN"), F.char(F.lit(1)), "n_name")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x"))
    return search.search_hits(rows, SearchSpec("A[A-N]", case=True, regex=True), "n_nationkey", "x").select("hit_no", "row_no", "position")


@query("select n_nationkey, upper(translate(x, 'iı', 'İI')) as up, lower(translate(x, 'Iİ', 'ıi')) as low from (select n_nationkey, lower(n_name) || 'ıİ ' || n_name as x from nation)")
def turkish_case(spark, sf_dir):
    x = F.concat(F.lower("n_name"), F.lit("ıİ "), "n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", search.turkish_upper_col(x).alias("up"), search.turkish_lower_col(x).alias("low"))


# --- bytes and units -------------------------------------------------------


@query("""
with b as (select n_nationkey, n_name, lower(hex(encode(n_name))) as h from nation)
select n_nationkey, '00000000  ' || rpad(rtrim(regexp_replace(h, '(..)', '\\1 ', 'g')), 47, ' ') || '  ' || n_name as dump from b
""")
def hex_dumps(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", b64.hex_dump(F.col("n_name").cast("binary")).alias("dump"))


@query("""
select n_nationkey, case n_nationkey % 3 when 0 then n_name || 'ğ' when 1 then n_name || 'ş' else n_name || n_name || n_name || chr(129) end as text,
  case n_nationkey % 3 when 0 then 'utf-8' when 1 then 'cp1254' else 'latin-1' end as encoding from nation
""")
def byte_encodings(spark, sf_dir):
    """Bytes as text in the first encoding that gives readable text."""
    name = F.col("n_name").cast("binary")
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("ğ")).cast("binary")).when(F.col("n_nationkey") % 3 == 1, F.concat(name, F.unhex(F.lit("FE"))))
    raw = raw.otherwise(F.concat(name, name, name, F.unhex(F.lit("81"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", b64.bytes_to_text(raw).alias("t")).select("n_nationkey", "t.text", "t.encoding")


@query("""
with n as (select o_orderkey, (2 * o_orderkey * 5000 + 1)::double as b, (o_orderkey % 9000 + 60)::bigint as s from orders)
select o_orderkey, case when b < 1024 then b::bigint || ' B' when b < 1048576 then replace(printf('%.1f', b / 1024), '.', ',') || ' KB' when b < 1073741824 then replace(printf('%.1f', b / 1048576), '.', ',') || ' MB'
    else replace(printf('%.1f', b / 1073741824), '.', ',') || ' GB' end as size,
  case when s < 3600 then s // 60 || ' dk ' || lpad((s % 60)::varchar, 2, '0') || ' sn'
    else s // 3600 || ' sa ' || lpad((s // 60 % 60)::varchar, 2, '0') || ' dk ' || lpad((s % 60)::varchar, 2, '0') || ' sn' end as time,
  case when o_orderkey % 2 = 0 then least(100.0, 100.0 * o_orderkey / 1000)::double else 0::double end as share, replace(format('{:,}', o_orderkey * 1000), ',', '.') || ' satır/sn' as rate from n
""")
def units(spark, sf_dir):
    """Sizes, durations, shares and rates in their spelling."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.byte_size(key * 10_000 + 1).alias("size"), text.duration((key % 9000 + 60).cast("double")).alias("time"),
        text.percent(key, F.when(key % 2 == 0, 1000).otherwise(0)).alias("share"), text.row_rate(key * 500, F.lit(0.5)).alias("rate"),
    )
