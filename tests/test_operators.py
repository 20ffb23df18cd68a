import pytest
from pyspark.sql import functions as F

from rowlens.operators import navigate, normalize, order, search
from rowlens.operators.select import Selection, add_bulk
from rowlens.spec import SearchSpec, SortSpec


def table(spark, values, name="v"):
    return spark.createDataFrame(list(enumerate(values)), f"row_no long, {name} string")


@pytest.mark.parametrize("descending", [False, True])
def test_top_k_boundary_ties_go_to_larger_rows(spark, descending):
    rows = table(spark, ["5", "5", "5", "1" if not descending else "9", "5", "5"])
    got = order.top_k(rows, SortSpec("v", descending, "number"), 3).orderBy("view_pos").collect()
    assert [r.row_no for r in got] == [3, 4, 5]


def test_top_k_text_counts_empty_and_leaves_out_null(spark):
    rows = table(spark, ["b", "", None, "a"])
    assert [r.row_no for r in order.top_k(rows, SortSpec("v"), 10).orderBy("view_pos").collect()] == [1, 3, 0]
    assert tuple(order.unreadable(rows, SortSpec("v")).first()) == (4, 1)


@pytest.mark.parametrize("k", [0, 200_001])
def test_top_k_limits(spark, k):
    with pytest.raises(ValueError):
        order.top_k(table(spark, ["a"]), SortSpec("v"), k)


NUMBERS = {
    "1.234": 1.234, "1.234,56": 1234.56, "1.234.567": 1234567.0, " 12 ": 12.0, "1_000": 1000.0, "1d": None, "nan": None, "": None, "-3,5": -3.5,
    "+.5e2": 50.0, "1e3": 1000.0, "1_": None, "__1": None, "abc": None, " 7": 7.0, "5.": 5.0,
}


def test_numbers_from_text(spark):
    rows = table(spark, list(NUMBERS))
    got = rows.select("row_no", order.number_key(F.col("v")).alias("n")).orderBy("row_no").collect()
    assert [r.n for r in got] == list(NUMBERS.values())
    inf = table(spark, ["inf", "-Infinity"]).select(order.number_key(F.col("v")).alias("n")).collect()
    assert [r.n for r in inf] == [float("inf"), float("-inf")]


def test_page_sort_is_stable_and_bounded(spark):
    rows = table(spark, ["2", "1", "2", "1", "x", "3"])
    got = order.sort_page(rows, SortSpec("v", True, "number"), 0, 5).orderBy("view_pos").collect()
    assert [r.row_no for r in got] == [0, 2, 1, 3]
    with pytest.raises(ValueError):
        order.sort_page(rows, SortSpec("v"), 0, 250_001)


MIXED = ["true", "1.5", '"b"', "[1]", "null", None, "false", "12345678901234567890123456789", "2.50", "1", '"B"', '{"a":1}', "2.5000"]


@pytest.mark.parametrize("descending", [False, True])
def test_mixed_sort(spark, descending):
    rows = table(spark, MIXED)
    got = [r.row_no for r in order.sort_mixed(rows, "v", descending, "row_no").collect()]
    flags, numbers, texts, rest = [6, 0], [9, 1, 8, 12, 7], [10, 2], [3, 11]
    if descending:
        flags, numbers, texts, rest = [0, 6], [7, 8, 12, 1, 9], [2, 10], [11, 3]
    assert got == flags + numbers + texts + rest + [4, 5]


def test_mixed_sort_is_numbered_over_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_no"), ((F.col("id") * 7919) % 5000).cast("string").alias("v")).repartition(7)
    view = order.sorted_view(order.sort_mixed(rows, "v", view_pos="row_no"), "view_pos").orderBy("view_pos").collect()
    assert [int(r.v) for r in view] == list(range(5000)) and [r.view_pos for r in view] == list(range(5000))


def test_mixed_sort_refuses_large_keys(spark):
    with pytest.raises(Exception, match="too large"):
        order.sort_mixed(table(spark, ['"' + "x" * 100 + '"']), "v", view_pos="row_no", max_key=50).collect()


def hits(rows, spec):
    return [(r.row_no, r.position) for r in search.search_hits(rows, spec, raw="v").orderBy("hit_no").collect()]


def test_search_reports_overlapping_occurrences(spark):
    rows = table(spark, ["aaaa", "baab", "x", "éaa"])
    assert hits(rows, SearchSpec("aa", case=True)) == [(0, 0), (0, 1), (0, 2), (1, 1), (3, 2)]
    assert tuple(search.search_total(rows, SearchSpec("aa", case=True), "v").first()) == (3, 5)


def test_search_folds_ascii_only(spark):
    rows = table(spark, ["The İ", "THE", "tİe", "theKK"])
    assert [r.row_no for r in search.search_rows(rows, SearchSpec("tHe"), "v").orderBy("row_no").collect()] == [0, 1, 3]
    assert hits(rows, SearchSpec("k")) == [(3, 3)]


def test_search_turkish_spellings(spark):
    rows = table(spark, ["İSTANBUL ŞİRKET", "şirket", "Şirket", "ŞIRKET", "sirket"])
    assert [r.row_no for r in search.search_rows(rows, SearchSpec("şirket"), "v").orderBy("row_no").collect()] == [0, 1, 2, 3]
    assert search.Pattern(SearchSpec("şirket")).approximate


def test_search_takes_special_characters_literally(spark):
    rows = table(spark, ["a.b", "axb", "\\E1", "(x"])
    for i, q in ((0, "a.b"), (2, "\\E"), (3, "(x")):
        assert hits(rows, SearchSpec(q, case=True)) == [(i, 0)]


def test_search_regex(spark):
    rows = table(spark, ["1;ke", "x 22 3", "Kı"])
    assert hits(rows, SearchSpec(r"\d+", regex=True)) == [(0, 0), (1, 2), (1, 5)]
    assert hits(rows, SearchSpec(r"^\d;k[eo]", regex=True)) == [(0, 0)]
    with pytest.raises(ValueError):
        search.Pattern(SearchSpec("(", regex=True))


def test_regex_hits_with_control_characters_and_empty_matches(spark):
    rows = table(spark, ["ab\0cd xx cd", "xx\1", "", "yxy"])
    assert hits(rows, SearchSpec("cd", regex=True)) == [(0, 3), (0, 9)]
    assert hits(rows, SearchSpec("x*", regex=True)) == [(0, i) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11)] + [(1, 0), (1, 2), (1, 3), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3)]
    with pytest.raises(ValueError):
        search.Pattern(SearchSpec("(?P<a>x)", regex=True))


def test_many_hits_on_a_line(spark):
    got = hits(table(spark, ["ax" * 3000, "xa" * 40]), SearchSpec("a", limit=10_000))
    assert got == [(0, 2 * i) for i in range(3000)] + [(1, 2 * i + 1) for i in range(40)]


def test_search_caps_hits_and_previews(spark):
    rows = table(spark, ["a" * 10, "é" * 400 + "a"])
    assert len(hits(rows, SearchSpec("a", limit=4))) == 4
    last = search.search_hits(rows, SearchSpec("a"), raw="v").where("row_no = 1").first()
    assert last.cut and last.position == 800 and last.preview == "é" * 300
    with pytest.raises(ValueError):
        SearchSpec("")


def test_search_does_not_depend_on_partitions(spark):
    rows = spark.range(300).select(F.col("id").alias("row_no"), F.concat(F.col("id").cast("string"), F.lit(";key;key")).alias("v"))
    spec = SearchSpec("key", case=True)
    assert hits(rows.repartition(1), spec) == hits(rows.repartition(13), spec)


def test_cell_search(spark):
    rows = spark.createDataFrame([(0, "ab", 1), (1, None, 11), (2, "b", 2)], "row_no long, v string, n int")
    assert [r.row_no for r in search.search_cells(rows, "1", ["v", "n"]).collect()] == [0, 1]
    assert search.search_cells(rows, "", ["v"]).count() == 0


def test_next_hit_goes_round():
    assert [search.step(3, 2), search.step(3, 0, False), search.step(0, 0)] == [0, 2, -1]


def test_turkish_case(spark):
    assert search.turkish_upper("iı") == "İI" and search.turkish_lower("Iİ") == "ıi"
    got = table(spark, ["iı", "Iİ"]).select(search.turkish_upper_col(F.col("v")).alias("u"), search.turkish_lower_col(F.col("v")).alias("l")).collect()
    assert got[0].u == "İI" and got[1].l == "ıi"


def test_navigation(spark):
    rows = table(spark, list("abcdef"))
    assert [r.v for r in navigate.window_rows(rows, 4, 5).collect()] == ["e", "f"]
    assert [r.v for r in navigate.fetch(rows, [3, 0, 3, 99]).collect()] == ["d", "a", "d"]
    assert navigate.go_to(rows, 5, page_rows=2).first().page == 2
    with pytest.raises(IndexError):
        navigate.go_to(rows, 6, total=6)
    assert navigate.page_bounds(1, 5, 4) == (4, 5)
    assert tuple(navigate.page_count(rows.limit(0), 4).first()) == (0, 1)
    view = rows.select(F.col("row_no"), (5 - F.col("row_no")).alias("view_pos"))
    assert navigate.at_position(view, 1, 6).first().row_no == 5 and navigate.position_of(view, 5).first().view_pos == 0
    assert navigate.legacy_page(view, 99, 6, 4).count() == 2
    assert navigate.shown_number(F.lit(0)) is not None and navigate.column_names(2) == ["Kolon 1", "Kolon 2"]


def test_first_seen_columns(spark):
    rows = table(spark, ['{"b":1,"a":2}', '{"c":1,"a":3}'])
    assert [r.name for r in navigate.first_seen_columns(rows, "v").orderBy("position").collect()] == ["b", "a", "c"]


def test_selection(spark):
    s = Selection(cap=3)
    assert [s.add(5), s.add(5), s.add(1)] == [True, False, True]
    assert s.add_all([1, 7, 8]) == (1, True) and s.rows() == [5, 1, 7] and s.in_source_order() == [1, 5, 7]
    assert s.full() and s.add(9) is None and s.toggle(5) is False and 5 not in s and len(s) == 2
    more = spark.createDataFrame([(0, 1), (1, 4), (2, 4), (3, 6)], "sel_pos long, row_no long")
    assert [(r.sel_pos, r.row_no) for r in add_bulk(s.table(spark), more, 4).orderBy("sel_pos").collect()] == [(0, 1), (1, 7), (2, 4), (3, 6)]
    with pytest.raises(ValueError):
        s.choose([])


def test_normalize_keeps_absent_and_null_apart(spark):
    rows = spark.createDataFrame([(0, '{"a":{"b":1},"l":[1],"e":{}}'), (1, '{"a":{"b":null},"z":"x"}')], "row_id long, record string")
    flat = normalize.flatten(rows)
    assert [r.name for r in normalize.columns(flat).orderBy("position").collect()] == ["a.b", "l", "e", "z"]
    got = {r.row_id: r for r in normalize.table(flat, ["a.b", "e", "z"]).collect()}
    assert got[0]["a.b"] == "1" and got[0]["e"] == "{}" and got[0]["z"] is None and "z" not in got[0].present
    assert got[1]["a.b"] is None and "a.b" in got[1].present
    normalize.check_collisions(flat)
    with pytest.raises(ValueError):
        normalize.check_collisions(normalize.flatten(spark.createDataFrame([(0, '{"a":{"b":1}}'), (1, '{"a.b":1}')], "row_id long, record string")))
