"""Queries over files and documents that are written for them first."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.plans.base import bracketed, query, scratch, table, write_documents, write_files
from rowlens.operators import order
from rowlens.session import open_file
from rowlens.sources import documents, export
from rowlens.sources.detect import open_path, refined_mean
from rowlens.spec import SortSpec
from rowlens.streaming import ingest


def _customers(spark, sf_dir, value, head="", tail=""):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("no"), value.alias("value"))
    return write_files(bracketed(rows, head, tail))


_CUSTOMERS = "select row_number() over (order by c_custkey) - 1 as row_no, c_custkey::varchar as id, c_name as name, c_mktsegment as segment from customer"


def _named(data) -> DataFrame:
    cols = data.spec.columns
    return data.table.select("row_no", *[F.col(c).alias(n) for c, n in zip(cols, ("id", "name", "segment"), strict=True)])


def _csv(spark, sf_dir, **settings):
    """The customers as delimited text with a header, opened."""
    path = _customers(spark, sf_dir, F.concat_ws(";", "c_custkey", "c_name", "c_mktsegment"), "id;name;segment")
    return open_file(spark, path, kind="csv", **settings)


# --- formats ---------------------------------------------------------------


@query(_CUSTOMERS)
def csv_roundtrip(spark, sf_dir):
    """Delimited text with a header, in several files: detected, split, numbered, decoded."""
    return _named(_csv(spark, sf_dir, split_bytes=4096))


@query(_CUSTOMERS)
def json_roundtrip(spark, sf_dir):
    """One JSON object a line inside a wrapper whose lines are no records."""
    value = F.concat(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))), F.lit(","))
    path = _customers(spark, sf_dir, value, '{"count": 1500, "rows": [', "]}")
    return _named(open_file(spark, path, kind="json", split_bytes=4096))


@query(_CUSTOMERS)
def xml_roundtrip(spark, sf_dir):
    value = F.format_string("<row><id>%s</id><name>%s</name><segment>%s</segment></row>", "c_custkey", "c_name", "c_mktsegment")
    path = _customers(spark, sf_dir, value, "<rows>", "</rows>")
    return _named(open_file(spark, path, kind="xml", split_bytes=4096))


@query(_CUSTOMERS)
def yaml_roundtrip(spark, sf_dir):
    value = F.format_string('- ["%s", "%s", "%s"]', "c_custkey", "c_name", "c_mktsegment")
    path = _customers(spark, sf_dir, value, "rows:")
    return _named(open_file(spark, path, kind="yaml", split_bytes=4096))


@query("select row_number() over (order by doc_id) - 1 as row_no, doc_id::varchar as id, text as body, lang as tongue from documents")
def csv_quoted_roundtrip(spark, sf_dir):
    """Quoted text with line feeds inside; splits begin in and out of quotes."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("no"), F.concat_ws(",", "doc_id", quote(F.col("text")), "lang").alias("value"))
    data = open_file(spark, write_files(rows, max(4, docs.rdd.getNumPartitions())), kind="csv", delimiter=",", header=False, quoted=True, split_bytes=1 << 20)
    return data.table.select("row_no", *[F.col(c).alias(n) for c, n in zip(data.spec.columns, ("id", "body", "tongue"), strict=False)])


@query(_CUSTOMERS)
def csv_sniffed(spark, sf_dir):
    """A byte order mark, a delimiter, a header and quotes, all found from the sample."""
    value = F.concat(F.col("c_custkey").cast("string"), F.lit('|"'), "c_name", F.lit('"|'), "c_mktsegment")
    return _named(open_file(spark, _customers(spark, sf_dir, value, "\ufeffid|name|segment"), kind="csv", split_bytes=4096))


@query("select count(*) as exact, true as near, true as refined from customer")
def row_estimate(spark, sf_dir):
    """The number of records against its estimates from the sample and from windows."""
    data = _csv(spark, sf_dir)
    n = data.count()
    mean = refined_mean(data.spec)
    size = sum(b - a for _, a, b in data.spec.regions())
    return spark.createDataFrame([(n, abs(data.estimate() - n) <= 0.2 * n, abs(size / mean - n) <= 0.2 * n)], "exact long, near boolean, refined boolean")


@query("select false as before, true as after")
def source_change(spark, sf_dir):
    """A file that is written again after it was opened."""
    rows = table(spark, sf_dir, "nation").select(F.lit(0).alias("doc"), F.col("n_nationkey").alias("no"), F.concat_ws(";", "n_nationkey", "n_name").alias("value"))
    path = write_documents(rows, ".csv")[0]
    data = open_file(spark, path)
    before = data.source_changed()
    fs, at = open_path(path)
    with fs.open_output_stream(at) as f:
        f.write(b"1;a\n2;b\n3;c\n")
    return spark.createDataFrame([(before, data.source_changed())], "before boolean, after boolean")


@query("select count(*) as exact, 10::bigint as declared, count(*) - 10 as difference from customer")
def integrity_check(spark, sf_dir):
    value = F.to_json(F.array(F.col("c_custkey").cast("string"), "c_name"))
    path = _customers(spark, sf_dir, value, '{"count": 10, "rows": [')
    return open_file(spark, path, kind="json", split_bytes=4096).integrity()


# --- reads of parts of files -----------------------------------------------

_LINES = 3_100_000


def _long_file(spark):
    rows = spark.range(_LINES).select(F.col("id").alias("no"), F.concat("id", F.lit(";"), F.col("id") * 7).alias("value"))
    return open_file(spark, write_files(rows, 8), kind="csv", header=False, split_bytes=1 << 20)


@query(f"select i as row_no, i::varchar as a, (7 * i)::varchar as b from range({_LINES - 100_000}, {_LINES - 99_750}) t(i)")
def file_window(spark, sf_dir):
    """250 rows from row 3,000,000 on: only the splits that hold them are read, by an index kept as a table."""
    data = _long_file(spark)
    folder = scratch(spark)
    data.save_index(folder)
    again = open_file(spark, data.spec.path, kind="csv", header=False, index=folder)
    a, b = data.spec.columns
    return again.rows(_LINES - 100_000, 250).select("row_no", F.col(a).alias("a"), F.col(b).alias("b"))


@query(f"select p as fetch_pos, i as row_no, (7 * i)::varchar as b from (values (0, {_LINES - 1}), (1, 5), (2, 5), (3, 99)) t(p, i)")
def file_fetch(spark, sf_dir):
    """Rows of a file in a given order; missing ones are left out."""
    data = _long_file(spark)
    return data.fetch([_LINES - 1, 5, 5, 99, 10**9]).select("fetch_pos", "row_no", F.col(data.spec.columns[1]).alias("b"))


_SEARCHED = """
with l as (select row_number() over (order by c_custkey) - 1 as row_no, c_custkey || ';' || c_name || ';' || c_mktsegment as x from customer),
h as (select row_no, octet_length(encode(substr(x, 1, instr(x, 'AUTO') - 1)))::bigint as position, x as preview from l where contains(x, 'AUTO') {and_} order by 1 limit {limit})
select row_number() over (order by row_no) - 1 as hit_no, row_no, position, preview from h
"""


@query(_SEARCHED.format(and_="", limit=5000))
def file_search(spark, sf_dir):
    """Occurrences in a file with row numbers, byte positions and previews."""
    return _csv(spark, sf_dir).search("AUTO", case=True).select("hit_no", "row_no", "position", "preview")


@query(_SEARCHED.format(and_="and row_no >= 60", limit=7))
def file_search_from(spark, sf_dir):
    """The first seven occurrences from a row on."""
    return _csv(spark, sf_dir).search("AUTO", case=True, limit=7, from_row=60).select("hit_no", "row_no", "position", "preview")


@query("""
with l as (select c_custkey, row_number() over (order by c_custkey) - 1 as row_no, c_name as x from customer),
b as (select *, coalesce(sum(octet_length(encode(x)) + 1) over (order by c_custkey rows between unbounded preceding and 1 preceding), 0)::bigint as base from l),
h as (select row_no, base, unnest(range(1, length(x) + 1)) as i, x from b), o as (select row_no, (i - 1)::bigint as position, base + i - 1 as offset_ from h where substr(x, i, 1) = '0')
select row_number() over (order by row_no, position) - 1 as hit_no, row_no, position, offset_::bigint as "offset" from (select * from o where offset_ >= 1000 order by row_no, position limit 90)
""")
def file_search_offset(spark, sf_dir):
    """The first 90 occurrences from a byte offset of one file on, each with its own offset."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("no"), F.col("c_name").alias("value"))
    data = open_file(spark, write_files(rows, 1), kind="csv", header=False)
    return data.search("0", limit=90, from_offset=1000).select("hit_no", "row_no", "position", "offset")


@query("""
with t as (select row_number() over (order by c_custkey) - 1 as row_no, c_name as sort_key from customer order by c_name desc, row_no desc limit 300)
select row_number() over (order by sort_key desc, row_no) - 1 as view_pos, row_no, sort_key from t
""")
def file_topk(spark, sf_dir):
    """A top-k by a cell of the records of a file."""
    return _csv(spark, sf_dir).top_k("name", 300, descending=True)


@query("select count(*) as examined, sum(octet_length(encode(c_name)))::bigint as bytes, 0::bigint as excluded, 40::bigint as shown, true as cut from customer")
def topk_report(spark, sf_dir):
    return order.top_k_report(table(spark, sf_dir, "customer"), SortSpec("c_custkey", kind="number"), 40, "c_name")


# --- strict documents ------------------------------------------------------

_NATIONS = "select n_regionkey::bigint as doc, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::bigint as row_id, n_nationkey::varchar as key, n_name as name from nation"


def _nations(spark, sf_dir, value, head=None, tail=None):
    """A document of lines for each region."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("long").alias("no"), value.alias("value"))
    for no, line in ((-1, head), (1 << 40, tail)):
        if line is not None:
            rows = rows.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), F.lit(no).cast("long").alias("no"), F.lit(line).alias("value")))
    return rows


def _loaded(spark, paths: list[str], key: str, name: str) -> DataFrame:
    got = documents.load(spark, f"{paths[0].rsplit('/', 1)[0]}/*{paths[0][paths[0].rindex('.'):]}")
    doc = F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long")
    return got.select(doc.alias("doc"), "row_id", F.get_json_object("record", key).alias("key"), F.get_json_object("record", name).alias("name"))


def _json_lines():
    return F.concat(F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("id")).alias("k"), F.col("n_name").alias("name"))), F.lit(","))


@query(_NATIONS)
def documents_json(spark, sf_dir):
    """JSON documents, a list of nested objects each, to records."""
    return _loaded(spark, write_documents(_nations(spark, sf_dir, _json_lines(), "[", "{}]"), ".json"), "$.k.id", "$.name").where("key is not null")


@query(_NATIONS)
def documents_csv(spark, sf_dir):
    value = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"'))
    return _loaded(spark, write_documents(_nations(spark, sf_dir, value, "key,name"), ".csv"), "$.key", "$.name")


@query(_NATIONS)
def documents_xml(spark, sf_dir):
    """XML documents: attributes, children and text."""
    value = F.format_string('<n id="%s"><name>%s</name></n>', "n_nationkey", "n_name")
    return _loaded(spark, write_documents(_nations(spark, sf_dir, value, "<all>", "</all>"), ".xml"), "$['@id']", "$.name")


@query(_NATIONS)
def documents_yaml(spark, sf_dir):
    value = F.format_string('- {key: %s, name: "%s"}', "n_nationkey", "n_name")
    return _loaded(spark, write_documents(_nations(spark, sf_dir, value), ".yaml"), "$.key", "$.name")


# --- imports ---------------------------------------------------------------


def _imported(spark, paths, selector, key, name, **limits) -> DataFrame:
    got = ingest.records(spark, paths, selector, **limits).where("row_id is not null")
    doc = F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long")
    return got.select(doc.alias("doc"), "row_id", F.get_json_object("record", key).alias("key"), F.get_json_object("record", name).alias("name"))


@query(_NATIONS)
def import_json(spark, sf_dir):
    """The second array of each JSON document."""
    paths = write_documents(_nations(spark, sf_dir, _json_lines(), '{"a": [1], "b": {"c": []}, "list": [', "{}]}"), ".json")
    return _imported(spark, paths, ingest.Selector("index", index=2), "$.k.id", "$.name").where("key is not null")


@query(_NATIONS)
def import_csv(spark, sf_dir):
    """Rows below a header; a record is a list."""
    value = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"'))
    return _imported(spark, write_documents(_nations(spark, sf_dir, value, "key,name"), ".csv"), ingest.Selector("rows"), "$[0]", "$[1]")


@query(_NATIONS)
def import_xml(spark, sf_dir):
    """Elements at a path."""
    value = F.format_string('<n id="%s"><name>%s</name></n>', "n_nationkey", "n_name")
    paths = write_documents(_nations(spark, sf_dir, value, "<all><x/><list>", "</list></all>"), ".xml")
    return _imported(spark, paths, ingest.Selector("path", path=("list", "n")), "$['@id']", "$.name")


@query(_NATIONS)
def import_yaml(spark, sf_dir):
    """A named list of each YAML document."""
    value = F.format_string('  - {key: %s, name: "%s"}', "n_nationkey", "n_name")
    paths = write_documents(_nations(spark, sf_dir, value, "other: 1\nlist:"), ".yaml")
    return _imported(spark, paths, ingest.Selector("name", name="list"), "$.key", "$.name")


@query("select r_regionkey::bigint as doc, 'record_limit' as outcome, 3::bigint as records from region")
def import_limits(spark, sf_dir):
    """How imports end that may take three records each."""
    paths = write_documents(_nations(spark, sf_dir, _json_lines(), "[", "{}]"), ".json")
    got = ingest.records(spark, paths, ingest.Selector(), max_records=3).where("row_id is null")
    return got.select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long").alias("doc"), F.col("kind").alias("outcome"), F.get_json_object("record", "$.records").cast("long").alias("records"))


@query("select 'byte_limit' as outcome, false as complete union all select 'selector_not_found', false union all select 'preview_complete', false union all select 'trailing_data', false")
def import_outcomes(spark, sf_dir):
    """Manifests of imports that don't end by themselves; none of them counts as complete."""
    good, bad = (write_documents(_nations(spark, sf_dir, _json_lines(), "[", tail), ".json") for tail in ("{}]", "{}] 1"))
    cases = ((good[0], ingest.Selector(), {"max_bytes": 90}), (good[1], ingest.Selector("name", "list"), {}), (good[2], ingest.Selector(), {"preview": True}), (bad[0], ingest.Selector(), {}))
    made = [ingest.import_document(spark, path, scratch(spark), selector, **limits) for path, selector, limits in cases]
    return spark.createDataFrame([(m.outcome, m.complete) for m in made], "outcome string, complete boolean")


@query("select 'object' as kind, count(*) + 1 as records, true as complete from nation where n_regionkey = 1")
def import_document(spark, sf_dir):
    """A named array of a JSON document imported into a store with a manifest."""
    path = write_documents(_nations(spark, sf_dir, _json_lines(), '{"meta": {"a": [1]}, "list": [', "{}]}"), ".json")[1]
    out = scratch(spark)
    m = ingest.import_document(spark, path, out, ingest.Selector("name", "list"))
    store, again = ingest.open_store(spark, out)
    return store.groupBy("kind").agg(F.count("*").alias("records")).withColumn("complete", F.lit(m.complete and again == m))


# --- exports ---------------------------------------------------------------


@query("select c_custkey || e'\\t' || c_name as line, ((c_custkey - (select min(c_custkey) from customer)) // 30)::int as part from customer where c_custkey < (select min(c_custkey) from customer) + 100")
def export_parts(spark, sf_dir):
    """A selection as files of 30 rows, read back."""
    rows = table(spark, sf_dir, "customer")
    first = rows.agg(F.min("c_custkey")).first()[0]
    chosen = rows.where(F.col("c_custkey") < first + 100).withColumn("sel_pos", F.col("c_custkey") - first)
    folder = scratch(spark)
    export.write_parts(chosen, ["c_custkey", "c_name"], folder, step=30)
    return spark.read.schema("value string, part int").text(folder).select(F.col("value").alias("line"), "part")


@query("select f as format, count(*) + 1 as rows from nation, (values ('xlsx'), ('docx'), ('html'), ('tsv')) t(f) group by f union all select 'pdf', 1")
def export_formats(spark, sf_dir):
    """Rows, header included, or pages of the exports of a table."""
    import zipfile

    def rows():
        chosen = table(spark, sf_dir, "nation").withColumn("sel_pos", F.col("n_nationkey"))
        return export.rows_of(chosen, ["n_name", "n_regionkey"], "n_nationkey")

    names, out = ["name", "region"], []
    for fmt, write, part, mark in (("xlsx", export.write_xlsx, "xl/worksheets/sheet1.xml", b"<row "), ("docx", export.write_docx, "word/document.xml", b"<w:tr>")):
        f = io.BytesIO()
        write(f, "Nations", names, rows())
        out.append((fmt, zipfile.ZipFile(f).read(part).count(mark)))
    out.append(("html", export.html_page("Nations", names, rows()).count("<tr>")))
    text = io.StringIO()
    export.write_tsv(text, names, rows())
    out.append(("tsv", text.getvalue().count("\n")))
    f = io.BytesIO()
    export.write_pdf(f, "Nations", names, rows())
    out.append(("pdf", f.getvalue().count(b"/Type /Page ")))
    return spark.createDataFrame(out, "format string, rows long")
