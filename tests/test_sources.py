import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from rowlens.functions import b64, text
from rowlens.session import open_file
from rowlens.sources import documents, export
from rowlens.sources import lines as recordlines
from rowlens.sources.detect import detect, refined_mean
from rowlens.spec import B64Spec, SourceError
from rowlens.streaming import ingest


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def lines(data):
    return [list(r.cells) for r in data.table.orderBy("row_no").collect()]


def test_self_identifying_cells_at_every_split_size(spark, tmp_path):
    p = put(tmp_path, "a.csv", "".join(f"{i}_0_aa;{i}_1_bb;{i}_2_cc\n" for i in range(2000)))
    for size in (64, 1000, 1 << 20):
        d = open_file(spark, p, split_bytes=size)
        assert d.spec.delimiter == ";" and d.spec.columns == ("Kolon 1", "Kolon 2", "Kolon 3")
        got = d.table.orderBy("row_no").collect()
        assert [r.row_no for r in got] == list(range(2000)) and all(r.cells[2] == f"{i}_2_cc" for i, r in enumerate(got))
        assert got[1].byte_offset == len("0_0_aa;0_1_bb;0_2_cc\n")


def test_quoted_line_feeds_at_every_split_size(spark, tmp_path):
    body = "name,note\r\n" + "".join(f'n{i},"line {i}\nnext ""{i}"" \r\nlast"\r\n' for i in range(300))
    for size in (7, 50, 1 << 20):
        d = open_file(spark, put(tmp_path, "q.csv", body), split_bytes=size, delimiter=",", header=True)
        got = lines(d)
        assert len(got) == 300 and got[7] == ["n7", 'line 7\nnext "7" \r\nlast']


def test_folders_and_globs_are_read_in_the_order_of_names(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv", "c.csv", "_skipped.csv", ".hidden.csv")):
        put(tmp_path, name, ("\ufeff" if i == 2 else "") + "id;note\n" + "".join(f"{name}{k};\"x\n{k}\"\n" for k in range(50)))
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "d.csv", "late;1")
    for path in (str(tmp_path), f"{tmp_path}/*.csv", f"file://{tmp_path}"):
        d = open_file(spark, path, kind="csv", split_bytes=300, header=True)
        got = d.table.orderBy("row_no").collect()
        assert [r.row_no for r in got] == list(range(151)) and d.count() == 151 and d.spec.columns == ("id", "note")
        assert [list(got[i].cells) for i in (0, 50, 149, 150)] == [["a.csv0", "x\n0"], ["b.csv0", "x\n0"], ["c.csv49", "x\n49"], ["late", "1"]]
    with pytest.raises(SourceError):
        open_file(spark, f"{tmp_path}/*.json")


def test_wrapped_records_over_many_files(spark, tmp_path):
    put(tmp_path, "0.json", '{"rows": [\n{"a": 1},\n{"a": 2},\n')
    put(tmp_path, "1.json", '{"a": 3},\n{"a": 4}\n')
    put(tmp_path, "2.json", "]}\n")
    assert lines(open_file(spark, str(tmp_path), kind="json")) == [["1"], ["2"], ["3"], ["4"]]


def test_known_rows_are_read_from_their_splits_only(spark, tmp_path):
    p = put(tmp_path, "n.csv", "".join(f"{i};v{i}\n" for i in range(20_000)))
    d = open_file(spark, p, split_bytes=2000, header=False)
    assert len(d.splits) > 90 and sum(s.rows for s in d.splits) == 20_000
    read = d._read
    seen = []
    d._read = lambda splits: seen.append(len(splits)) or read(splits)
    assert [r.row_no for r in d.rows(15_000, 30).collect()] == list(range(15_000, 15_030)) and seen[-1] <= 2
    assert [r.row_no for r in d.fetch([19_999, 0, 0, 50_000]).collect()] == [19_999, 0, 0] and seen[-1] == 2
    assert d.goto(7).first().cells == ["7", "v7"] and seen[-1] == 1
    d.save_index(str(tmp_path / "index"))
    again = open_file(spark, p, header=False, index=str(tmp_path / "index"))
    assert again.splits == d.splits and again.rows(19_990, 100).count() == 10
    put(tmp_path, "n.csv", "1;2\n3;4\n5;6\n")
    assert d.source_changed()
    with pytest.raises(SourceError):
        open_file(spark, p, header=False, index=str(tmp_path / "index"))


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, f):
        self.f, self.n = f, 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        got = self.f.read(n)
        self.n += len(got)
        return got


def test_tasks_and_reads_grow_with_the_bytes_and_not_with_the_splits(spark, tmp_path):
    data = b"".join(b"%d;%0100d\n" % (i, i) for i in range(5000)) + b"long;" + b"x" * 300_000 + b"\nlast;1"
    d = detect(put(tmp_path, "n.csv", data), header=False)
    splits = recordlines.splits_of(d, 4096)
    assert len(splits) > 200 and recordlines._table(spark, splits).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    with open(d.path, "rb") as f:
        held = Counted(f)
        got = [raw for s in splits for _, raw in recordlines.split_records(held, s, False)]
    assert b"\n".join(got) == data and held.n < 4 * len(data)


def test_tasks_hold_equal_bytes():
    mib = 1 << 20
    small = [recordlines.Split(i, f"s{i}", 0, 1000, 1000, True) for i in range(5000)]
    big = [recordlines.Split(5000 + i, "b", 16 * mib * i, 16 * mib * (i + 1), 1600 * mib, not i) for i in range(100)]
    tasks = recordlines.dealt(small + big, 8)
    assert [s for t in tasks for s in t] == small + big
    assert max(len(t) for t in tasks if t[-1].path == "b") < 100 and max(sum(s.end - s.start for s in t) for t in tasks) < 17 * mib
    assert recordlines.dealt(big[:3], 8) == [[s] for s in big[:3]] and recordlines.dealt([], 8) == []


def test_search_from_an_offset(spark, tmp_path):
    p = put(tmp_path, "s.csv", "ab;é;ab\nab;x;y\nq;ab;z\n")
    got = open_file(spark, p, header=False).search("ab", case=True, from_offset=3).collect()
    assert [(r.row_no, r.position, r.offset) for r in got] == [(0, 6, 6), (1, 0, 9), (2, 2, 18)]


def test_quoted_records_are_cut_at_line_feeds_only(spark, tmp_path):
    marks = ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r", "\ue000"]
    body = "".join(f'{i},ab{c}cd,"x{c}\r\n""y{c}",end\n' for i, c in enumerate(marks))
    for size in (7, 1 << 20):
        got = lines(open_file(spark, put(tmp_path, "m.csv", body), split_bytes=size, delimiter=",", header=False, quoted=True))
        assert got == [[str(i), f"ab{c}cd", f'x{c}\r\n"y{c}', "end"] for i, c in enumerate(marks)]
    stray = lines(open_file(spark, put(tmp_path, "s.csv", 'a,5" x\nb,c"d\ne,"f"\n'), delimiter=",", header=False, quoted=True))
    assert stray == [["a", '5" x\nb', 'c"d'], ["e", "f"]]


def test_cells_longer_than_the_csv_limit(spark, tmp_path):
    before, long = csv.field_size_limit(), "ab," * 66_667
    body = f'1,"{long}",x\n2,short,y\n'
    d = open_file(spark, put(tmp_path, "long.csv", body), split_bytes=1 << 16, delimiter=",", header=False, quoted=True)
    assert lines(d) == [["1", long, "x"], ["2", "short", "y"]] and csv.field_size_limit() == before
    assert documents.csv_records(f'a,b\n1,"{long}"\n') == [{"a": "1", "b": long}]


def test_header_needs_a_reason(tmp_path):
    assert detect(put(tmp_path, "h.csv", "ad,yas\nali,3\nveli,4\n")).header
    assert not detect(put(tmp_path, "n.csv", "aa,bb\ncc,dd\nee,ff\n")).header


@pytest.mark.parametrize("name,data", [
    ("a.json", b"\xff\xfe{\x00"), ("a.csv", b""), ("a.json", b'{\n "a": 1,\n "b": 2,\n "c": 3,\n "d": 4,\n "e": 5\n}\n'), ("a.bin", b"x\n"),
])
def test_refused_files(tmp_path, name, data):
    with pytest.raises(SourceError):
        detect(put(tmp_path, name, data))


def test_json_wrapper_declared_count_and_tail(spark, tmp_path):
    rows = "".join(f'["{i}", {i}, null, true],\n' for i in range(50))
    d = open_file(spark, put(tmp_path, "w.json", '{"count":60,"rows":[\n' + rows + '["x", [1, 2], {"a": 1}, 1.5]\n]}\n'), split_bytes=100)
    got = lines(d)
    assert len(got) == 51 and got[3] == ["3", "3", "", "true"] and got[50] == ["x", "[1, 2]", '{"a": 1}', "1.5"]
    assert tuple(d.integrity().first()) == (51, 60, -9) and d.estimate() == 60


def test_last_line_without_its_end(spark, tmp_path):
    p = put(tmp_path, "t.jsonl", '{"a":1}\n{"a":2}\n{"a":3}')
    assert open_file(spark, p).count() == 3
    assert open_file(spark, p, compat_tail=True).count() == 2


def test_columns_come_from_the_first_ten(spark, tmp_path):
    p = put(tmp_path, "u.jsonl", "".join(json.dumps({"a": i} | ({"late": 1} if i == 10 else {})) + "\n" for i in range(12)))
    assert detect(p).columns == ("a",)


def test_columns_of_all_records(spark, tmp_path):
    body = [json.dumps({"a": i} | ({"late": i, "b": 1} if i >= 10 else {})) for i in range(13)]
    for name, text in (("v.jsonl", "".join(x + "\n" for x in body)), ("v.yaml", "".join(f"- {x}\n" for x in body))):
        d = open_file(spark, put(tmp_path, name, text), split_bytes=64, columns="all")
        assert d.spec.columns == ("a", "late", "b") and [r.late for r in d.table.orderBy("row_no").collect()] == [""] * 10 + ["10", "11", "12"]
    wide = put(tmp_path, "w.jsonl", "[1]\n" * 11 + "[1, 2, 3]\n")
    assert open_file(spark, wide, columns="all").spec.columns == ("Kolon 1", "Kolon 2", "Kolon 3")
    with pytest.raises(ValueError):
        open_file(spark, put(tmp_path, "v.csv", "a;b\nc;d\n"), columns="all")


def test_xml_and_yaml_lines(spark, tmp_path):
    x = put(tmp_path, "x.xml", "<rows count=\"3\">\n" + "".join(f"<r><ad>a{i}</ad><yas/></r>\n" for i in range(30)) + "</rows>\n")
    d = open_file(spark, x, split_bytes=64)
    assert d.spec.columns == ("ad", "yas") and lines(d)[4] == ["a4", ""] and d.spec.declared == 3
    y = put(tmp_path, "y.yaml", "count: 30\nrows:\n" + "".join(f"- [a{i}, {i}, true, null]\n" for i in range(30)))
    d = open_file(spark, y, split_bytes=64)
    assert lines(d)[3] == ["a3", "3", "true", ""] and d.spec.declared == 30


def test_other_encodings_and_bom(spark, tmp_path):
    assert lines(open_file(spark, put(tmp_path, "b.csv", b"\xef\xbb\xbfa;1\nb;2\nc;3\n"), header=False))[0] == ["a", "1"]
    assert lines(open_file(spark, put(tmp_path, "c.csv", "ş;1\nğ;2\n".encode("cp1254")), encoding="cp1254", header=False))[1] == ["ğ", "2"]


def test_ragged_rows_and_estimate(spark, tmp_path):
    d = open_file(spark, put(tmp_path, "r.csv", "1;2;3\n4;5\n6;7;8;9\n" * 20), header=False)
    r = d.table.where("row_no = 1").first()
    assert r["Kolon 3"] == "" and len(d.spec.columns) == 4
    assert abs(d.estimate() - 60) <= 6 and refined_mean(d.spec) > 0


def test_session(spark, tmp_path):
    p = put(tmp_path, "s.csv", "k;v\n" + "".join(f"{i};{i % 3}\n" for i in range(100)))
    d = open_file(spark, p, page_rows=10, header=True)
    assert d.pages() == 10 and [r.k for r in d.rows(98, 5).collect()] == ["98", "99"] and d.goto(55).first().page == 5
    assert [r.row_no for r in d.top_k("v", 2, True, "number").orderBy("view_pos").collect()] == [95, 98]
    assert [r.row_no for r in d.sort_list("v", [2, 1, 0, 2]).orderBy("view_pos").collect()] == [0, 1, 2, 2]
    assert d.search("9;").count() == 10 and not d.source_changed()
    d.reset_view()
    assert d.view is None


def test_exports(spark, tmp_path):
    p = put(tmp_path, "e.csv", "a;b\n" + "".join(f"<{i}>;ğ{i}\n" for i in range(100)))
    d = open_file(spark, p, header=True)
    d.selection.add_all([5, 3, 999])
    for fmt in ("xlsx", "docx", "pdf", "tsv", "html"):
        d.export(fmt, str(tmp_path / f"o.{fmt}"), "Title")
    assert (tmp_path / "o.tsv").read_text() == "a\tb\n<5>\tğ5\n<3>\tğ3\n"
    for fmt, part in (("xlsx", "xl/worksheets/sheet1.xml"), ("docx", "word/document.xml")):
        with zipfile.ZipFile(tmp_path / f"o.{fmt}") as z:
            assert z.testzip() is None
            assert "<5>" in "".join(ET.fromstring(z.read(part)).itertext())
    pdf = (tmp_path / "o.pdf").read_bytes()
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert pdf[at : at + 4] == b"xref" and b"&lt;5&gt;" in (tmp_path / "o.html").read_bytes()
    out = io.BytesIO()
    export.write_pdf(out, "t", ["c"], ((i, [str(i)]) for i in range(200)))
    assert out.getvalue().count(b"/Type /Page ") == 5


def test_b64(spark):
    rows = spark.createDataFrame([(0, "QQ"), (1, "QUI="), (2, "!"), (3, "QUJDR"), (4, ""), (5, "QQ==QQ=="), (6, "_-8=")], "i int, s string")
    got = {r.i: r for r in rows.select("i", b64.decode(F.col("s")).alias("b"), b64.problem(F.col("s")).alias("p"), b64.decode_strict(F.col("s")).alias("t"), b64.decode(F.col("s"), True).alias("u")).collect()}
    assert bytes(got[0].b) == b"A" and got[0].t is None and bytes(got[1].t) == b"AB" and bytes(got[5].b).startswith(b"A")
    assert [got[i].p for i in (2, 3, 4)] == ["alphabet", "length", "empty"] and bytes(got[6].u) == b"\xff\xef" and got[6].p == "alphabet"
    dump = spark.createDataFrame([(bytearray(b"A\x00" * 2100),)], "b binary").select(b64.hex_dump("b").alias("d")).first().d
    assert dump.startswith("00000000  41 00 41") and dump.endswith("... (104 more bytes)")
    assert b64.text_of(b"\xfe\xf0") == ("şğ", "cp1254") and b64.text_of(b"\x00\x01\x02") == (None, None)
    assert b64.suggest(["abc", "!"]) is None
    with pytest.raises(ValueError):
        B64Spec((0,), prefix_mode="marker")


def test_units(spark):
    r = spark.range(1).select(
        text.grouped(F.lit(1234567)).alias("n"), text.byte_size(F.lit(38400000000)).alias("b"), text.duration(F.lit(0.0431)).alias("m"), text.duration(F.lit(91.4)).alias("d"),
        text.byte_rate(F.lit(1 << 30), F.lit(1.0)).alias("r"), text.percent(F.lit(1), F.lit(0)).alias("p"), text.row_rate(F.lit(10), F.lit(0.0)).alias("z"),
    ).first()
    assert tuple(r) == ("1.234.567", "35,8 GB", "43,1 ms", "1 dk 31 sn", "1,0 GB/sn", 0.0, "-")
    shown = spark.createDataFrame([('[1,{"a":null}]',), ("true",), (None,)], "v string").select(text.json_as_text_exact("v").alias("e"), text.json_as_text(F.col("v"), True).alias("l")).collect()
    assert [x.e for x in shown] == ['[1, {"a": null}]', "true", ""] and [x.l for x in shown] == ['[1,{"a":null}]', "True", ""]


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "[1]", "3", '{"a":NaN}', '{"a":1e999}', "{"])
def test_strict_json(bad):
    with pytest.raises(SourceError):
        documents.json_records(bad)


def test_documents(spark, tmp_path):
    assert documents.json_records("[]") == [] and documents.csv_records('a,b\n1,"x\ny"\n\n3,4\n')[0] == {"a": "1", "b": "x\ny"}
    for bad in ("a,a\n1,2\n", "a,b\n1\n", "", 'a\n"x'):
        with pytest.raises(SourceError):
            documents.csv_records(bad)
    xml = "<r><i id='007'><n>1</n><t>a</t><t>b</t><g><x>1</x></g></i></r>"
    assert documents.xml_records(xml) == [{"@id": "007", "n": "1", "t": ["a", "b"], "g": {"x": "1"}}]
    for bad in ("<r><i>t<x/></i></r>", "<r><i>t</i></r>", "<r>"):
        with pytest.raises(SourceError):
            documents.xml_records(bad)
    assert documents.yaml_records("- a: 1\n- b: x\n") == [{"a": 1}, {"b": "x"}]
    for bad in ("- a: 2020-01-01\n", "- 1: x\n", "a: &x [*x]\n", "- !!set {a}\n"):
        with pytest.raises(SourceError):
            documents.yaml_records(bad)
    p = put(tmp_path, "d.json", '[{"a":1},{"b":{"c":2}}]')
    assert [r.record for r in documents.load(spark, p).orderBy("row_id").collect()] == ['{"a": 1}', '{"b": {"c": 2}}']


CASES = [
    ("a.json", '[{"x":1},2,[3]]', ingest.Selector(), {}, "complete", 3),
    ("a.json", '{"m":[9],"k":[1,2]}', ingest.Selector("name", "k"), {}, "complete", 2),
    ("a.json", '{"m":1,"k":[1,2],"z":[3]}', ingest.Selector("index", index=2), {}, "complete", 1),
    ("a.json", '{"m":1,"k":[1,2]}', ingest.Selector("first_array"), {}, "complete", 2),
    ("a.json", '{"m":1}', ingest.Selector("name", "k"), {}, "selector_not_found", 0),
    ("a.json", '[1,2', ingest.Selector(), {}, "invalid_document", 2),
    ("a.json", "[1] x", ingest.Selector(), {}, "trailing_data", 1),
    ("a.json", "[1,2,3]", ingest.Selector(), {"max_records": 2}, "record_limit", 2),
    ("a.json", "[10,20,30]", ingest.Selector(), {"max_bytes": 5}, "byte_limit", 1),
    ("a.csv", "a,b\n1,2\n3,4\n", ingest.Selector("rows"), {}, "complete", 2),
    ("a.csv", "a,b\n1\n", ingest.Selector("rows"), {}, "width_mismatch", 0),
    ("a.csv", "", ingest.Selector("rows"), {}, "empty_source", 0),
    ("a.xml", "<r><k><i><a>1</a></i><i><a>2</a></i></k></r>", ingest.Selector("path", path=("k", "i")), {}, "complete", 2),
    ("a.xml", "<r><i/></r>", ingest.Selector("path", path=("z",)), {}, "selector_not_found", 0),
    ("a.yaml", "m: 1\nk:\n- {a: 1}\n- {a: 2}\n", ingest.Selector("name", "k"), {}, "complete", 2),
    ("a.yaml", "- 1\n---\n- 2\n", ingest.Selector(), {}, "trailing_data", 1),
    ("a.yaml", "- &x 1\n- *x\n", ingest.Selector(), {}, "invalid_document", 0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_import_outcomes(tmp_path, case):
    name, body, selector, limits, outcome, n = CASES[case]
    p = put(tmp_path, name, body)
    kind = ingest.check_config(p, selector)
    rows = list(ingest._import_one(p, kind, selector, limits.get("max_records"), limits.get("max_bytes")))
    assert rows[-1][1] == outcome and len(rows) - 1 == n and outcome in ingest.OUTCOMES


def test_import_writes_a_manifest_once(spark, tmp_path):
    p = put(tmp_path, "m.json", json.dumps([{"i": i} for i in range(30)] + [1]))
    m = ingest.import_document(spark, p, str(tmp_path / "store"), ingest.Selector())
    store, again = ingest.open_store(spark, str(tmp_path / "store"))
    assert m == again and m.complete and m.kinds == {"object": 30, "scalar": 1} and store.count() == 31
    with pytest.raises(SourceError):
        ingest.import_document(spark, p, str(tmp_path / "store"), ingest.Selector())
    few = ingest.import_document(spark, p, str(tmp_path / "few"), ingest.Selector(), preview=True, max_records=5)
    assert few.outcome == "record_limit" and not few.complete and few.records == 5


def test_line_data_source(spark, tmp_path):
    from rowlens.sources.lines import RecordLines

    spark.dataSource.register(RecordLines)
    p = put(tmp_path, "l.csv", "".join(f"{i};x\n" for i in range(500)))
    got = spark.read.format("recordlines").option("path", p).option("splitbytes", "100").load().orderBy("byte_offset").collect()
    assert [r.line for r in got] == [f"{i};x" for i in range(500)]
