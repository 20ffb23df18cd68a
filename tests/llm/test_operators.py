"""The training-text operators against brute force, libraries and SQL on small tables."""

import collections
import hashlib
import pathlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlens.llm import decontaminate, jaccard, mixing, queries, quotes, suffix_dedup, token_counts, token_files, token_text, topk, toxicity, url_filter
from rowlens.llm.components import components
from rowlens.llm.shingles import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string"
EDGE = [None, "", " \n ", "word", "same text here now ok", "same text here now ok", "x" * 3000, "A b c d E f g h " * 40, "É é ü.\tü\r\n ok", "<|endoftext|> end"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 3}", None, "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def made(seed=3, n=60):
    """Texts with shared passages, exact and near copies."""
    r = random.Random(seed)
    vocab = ["th", "er", "on", "an", "re", "hé", "in", "ed"]
    word = lambda: "".join(r.choice(vocab) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(25) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
        elif out and kind < 0.45:
            ws = r.choice(out).split(" ")
            for _ in range(r.randint(1, 3)):
                ws[r.randrange(len(ws))] = word()
            out.append(" ".join(ws))
        else:
            out.append(" ".join(p for p in (text(r.randint(1, 60)), r.choice(passages) if r.random() < 0.5 else "", text(r.randint(1, 60))) if p))
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf, duck, as_rows):
    got = as_rows(queries.QUERIES[name](spark, sf).toPandas())
    assert got == as_rows(duck.sql(queries.ORACLES[name]).df())


# --- op1 ---

def test_targets_are_capped_and_reshared():
    got = mixing.targets({"b": 100, None: 1000, "a": 10})
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1110) and got["b"] == 200
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 7).cast("int")), " ").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 9 > 0, "b")).alias("source"))
    one, two = (sorted(mixing.mix_sources(docs).collect()) for _ in range(2))
    assert one == two and all(r.taken in (0, r.size, 2 * r.size) for r in one)
    by = collections.Counter()
    for r in one:
        by[r.source] += r.taken
    for s in {r.source for r in one}:
        assert abs(by[s] - next(r.target for r in one if r.source == s)) <= 12
    assert sum(by.values()) <= 1.5 * sum(r.size for r in one)


def test_rows_of_one_id_are_apart_in_the_order(spark, monkeypatch):
    docs = frame(spark, [f"w{i} " * (i % 5 + 1) for i in range(300)], [None] * 150 + [4] * 150)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 300 and len({r.taken for r in got}) > 1
    monkeypatch.setattr(mixing, "SLICE_ROWS", 1)
    monkeypatch.setattr(mixing, "SLICES", 4)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == sorted(map(str, got))


def test_mix_edges(spark, monkeypatch):
    got = mixing.mix_sources(frame(spark, EDGE, [0, 0, None, None, 4, 4, 5, 6, 7, 8])).collect()
    assert len(got) == len(EDGE) and sum(r.size for r in got) == sum(len(words(t)) for t in EDGE)
    assert mixing.mix_sources(frame(spark, EDGE).limit(0)).count() == 0
    whole = sorted(mixing.mix_sources(frame(spark, made())).collect())
    monkeypatch.setattr(mixing, "CUT_ROWS", 5)
    assert sorted(mixing.mix_sources(frame(spark, made())).collect()) == whole


# --- op2 ---

def brute_repeats(rows):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if d is not None else ():
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    texts = made() + EDGE + ["x" * 49, "x" * 50, "x" * 400, made()[0] * 30]
    ids = [*range(len(texts) - 3), 5, None, 5]
    got = suffix_dedup.remove_repeats(frame(spark, texts, ids).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(list(zip(ids, texts, strict=True)))
    assert suffix_dedup.remove_repeats(frame(spark, texts, ids).limit(0)).count() == 0


@pytest.mark.parametrize("operator", [lambda d: toxicity.keep_clean(d, toxicity.Model()), lambda d: jaccard.jaccard_components(d.limit(0))])
def test_batches_of_texts_are_bounded_by_bytes(spark, operator):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 500).alias("text"))
    spark.conf.unset(name)
    try:
        operator(docs)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 5 << 20
        spark.conf.set(name, "1000000")
        operator(docs)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)


def shuffle_files(spark):
    return {f: f.stat().st_size for f in pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}


def test_repeats_leave_no_shuffles_of_stored_steps(spark):
    """What the steps shuffled goes with them, and not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, was, before = frame(spark, made(n=400)), spark.conf.get(name, None), shuffle_files(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    suffix_dedup.remove_repeats(docs)
    for _ in range(50):
        left = sum(n for f, n in shuffle_files(spark).items() if f not in before)
        if left < size // 2:
            break
        time.sleep(0.2)
    assert left < size // 2
    assert spark.conf.get(name, None) == was
    spark.conf.set(name, "true")
    try:
        suffix_dedup.remove_repeats(docs)
        assert spark.conf.get(name) == "true"
    finally:
        spark.conf.unset(name)


def test_marks_are_written_only_where_ids_repeat(spark):
    texts = [*made(n=30), "short", None]
    marks = lambda ids: [r.mark for r in suffix_dedup._marked(frame(spark, texts, ids).select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")))[0].collect()]
    own = [*range(30), None, None]  # rows without an id meet no others
    assert set(marks(own)) == {0}
    assert len(set(marks([*range(30), 3, None]))) == len(set(texts))  # a short text with a long one's id
    for ids in (own, [*range(30), 3, None]):
        got = suffix_dedup.remove_repeats(frame(spark, texts, ids).repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == brute_repeats(list(zip(ids, texts, strict=True)))


def test_batches_of_repeats_give_the_same(spark, monkeypatch):
    ids = [7 * k % 61 for k in range(60)]
    whole = brute_repeats(list(zip(ids, made(), strict=True)))
    for batch, held in ((1, 1), (3000, 500)):
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
        monkeypatch.setattr(suffix_dedup, "HELD_STRINGS", held)
        assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, made(), ids)).collect()), key=str) == whole


def test_packed_runs_and_strings_compress():
    """One string or two of a row are in a fragment: what names the row must not weigh as much as the strings."""
    rng, n = np.random.default_rng(0), 2000
    own = np.sort(rng.choice(100_000, n, False))
    marks = rng.integers(-(1 << 63), 1 << 63, n)
    names = rng.integers(0, 1 << 63, n)
    strings = (names.astype("<u8"), (names >> 20).astype("<u2"), rng.integers(0, 3000, n).astype("<u4"), np.ones(n, "<u4"), own.astype("<i8"), marks.astype("<i8"))
    runs = (names.astype("<u4"), names.astype("<u8"), rng.integers(0, 200, n).astype("<u2"), np.ones(n, "<u4"), -own.astype("<i8"), marks.astype("<i8"), np.zeros(n, "<u4"))
    for arrays, kinds in ((strings, suffix_dedup._STRINGS), (runs, suffix_dedup._RUNS)):
        raw = suffix_dedup._pack(*arrays)
        back = suffix_dedup._unpack(raw, *kinds)
        assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))
        assert len(pa.Codec("lz4_raw").compress(raw)) < 0.7 * sum(a.nbytes for a in arrays)
    assert [len(x) for x in suffix_dedup._unpack(suffix_dedup._pack(*(a[:0] for a in runs)), *suffix_dedup._RUNS)] == [0] * 7


# --- op3 ---

def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    base = [list(map(float, v)) for v in r.normal(size=(300, 16)) * r.uniform(0.01, 3, size=(300, 1))]
    base += [base[0], base[0], [0.0] * 16, None, [], [None] * 16, [float("nan")] * 16, [1.0] * 3, [2.0] * 3]
    rows = [(i, v, None) for i, v in enumerate(base)] + [(None, base[1], None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    good = {i: np.floor(np.array(x) * 256).astype(int) for i, x, _ in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)}
    exp = []
    for q in sorted(i for i in good if i % 50 == 0):
        s = sorted((-int(good[q] @ c), i) for i, c in good.items() if i != q and len(c) == len(good[q]))[:5]
        exp += [(q, k, i, -n) for k, (n, i) in enumerate(s, 1)]
    assert got == exp
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_large_components_end_the_query(spark):
    rows = [(0, [1.0, -3e6]), (1, [2.0, 4e6]), (50, [-4e5, 3e6])]  # products beyond 2**53
    good = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(good, good.where("vec_id % 50 = 0")).collect()}
    v = {i: [int(np.floor(x * 256)) for x in e] for i, e in rows}
    assert got == {(a, b): sum(x * y for x, y in zip(v[a], v[b], strict=True)) for a in (0, 50) for b in v if a != b}
    for bad in ([1e30, 1.0], [3e15, 3e15]):
        vs = spark.createDataFrame([(0, bad), (1, bad), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large|64 bits"):
            topk.top_k(vs, vs.where("vec_id = 0")).collect()


def test_blocks_and_partitions_of_vectors_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(int(i) if i % 3 else 9, list(map(float, x))) for i, x in enumerate(r.normal(size=(300, 6)))], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 4 = 0")).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "PART_BYTES", 1000)
    monkeypatch.setattr(topk, "SEED", 10)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 4 = 0")).collect())) == whole


def test_coordinate_pruning_loses_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    centre = r.normal(size=(5, 8))
    vs = [(i, list(map(float, centre[i % 5] + r.normal(size=8) * 0.1))) for i in range(400)]
    v = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0")).collect()))
    monkeypatch.setattr(topk, "COORDINATE_FROM", 9.0)
    assert got == sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0")).collect()))


# --- op4, op10 ---

TEXTS = EDGE + [
    " a", "a  b", "x\n\ny <|endoftext|> z.", "<|ENDOFTEXT|> It's a tést... don'T. we'Re\tHi\r\n ok", "İstanbul Σας ſ éx y", "a.\n b,c d., e '.", "ab\x1cq r\x85s t u",
    "1,234 5. x5. ab. \n", "é. à, É,", "a<|endoftext|>b", "Word word. WORD, wörd", "数字 テスト, ok",
]


def library(name):
    return token_text.load(token_text.tokenizer_path(name))


def test_counts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT_CHARS", 500)
    texts = TEXTS + made()
    got = token_counts.token_counts(frame(spark, texts), token_text.tokenizer_path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    t = library("byte_bpe_50k.json")
    exp = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert [r.n_tokens for r in got] == exp and [r.n_bytes for r in got] == [len((x or "").encode()) for x in texts]
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(frame(spark, texts).limit(0), token_text.tokenizer_path("byte_bpe_50k.json")).count() == 0


ALPHABET = ["a", "b", "the", "é", "ß", "数", "字", "。", "，", "م", "ر", "،", "д", "и", " ", " ", " ", "\n", "\n", "\xa0", "\u2028", "\t", "\r", "\x1c", "\x85", ".", ",", "'s", "'", "<|endoftext|>", "1", "²", "ँ", "ि", "क", "\u0301", "İ", "ı", "!", "?", "  ", "-", "_"]


def strange(n, seed=5):
    r = random.Random(seed)
    return ["a\xa0b\n\xa0", *("".join(r.choice(ALPHABET) for _ in range(r.randint(1, 25))) for _ in range(n - 1))]


def test_strange_texts_and_parts_of_them_equal_the_library():
    texts = strange(20_000)
    p = token_text.tokenizer_path("byte_bpe_50k.json")
    exp = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [n for i in range(0, len(texts), 500) for n in token_text.count_tokens(texts[i : i + 500], p)] == exp
    assert [sum(token_text.count_tokens(list(token_text.segments(x, 6)), p)) for x in texts] == exp
    p = token_text.tokenizer_path("word_bpe_49k.json")
    exp = [np.array(e.ids, "<u2").tobytes() for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 500) for x in token_text.encode_ids(texts[i : i + 500], p, "<u2")] == exp
    assert [b"".join(token_text.encode_ids(list(token_text.segments(x, 6)), p, "<u2")) for x in texts] == exp


@pytest.mark.parametrize("unit", ["数字テスト。", "привет, мир; ", "مرحبا بالعالم، "])
def test_long_texts_of_any_script_are_cut(unit):
    text = unit * 2000
    parts = list(token_text.segments(text, 1000))
    assert "".join(parts) == text and max(map(len, parts)) <= 1000 + len(unit) * 2
    assert list(token_text.segments("x" * 5000, 1000)) == ["x" * 5000]


def test_small_tables_of_pieces_give_the_same(monkeypatch):
    monkeypatch.setattr(token_text, "TABLE_ENTRIES", 20)
    monkeypatch.setattr(token_text, "_tables", {})
    p = token_text.tokenizer_path("byte_bpe_50k.json")
    texts = made()
    got = [n for i in range(0, len(texts), 7) for n in token_text.count_tokens(texts[i : i + 7], p)]
    assert got == [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]


def test_width_of_ids(spark, tmp_path):
    p = token_text.tokenizer_path("word_bpe_49k.json")
    assert not token_files.needs_wide(p, 2) and token_files.needs_wide(p, 70_000)
    with pytest.raises(OverflowError):
        token_text.encode_ids(["some plain words here"], p, "<u1")
    got = token_files.token_files(frame(spark, ["one two", None]), p, end_id=70_000).orderBy("doc_id").collect()
    ids = library("word_bpe_49k.json").encode("one two", add_special_tokens=False).ids
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array([*ids, 70_000], "<u4").tobytes()), zlib.crc32(np.array([70_000], "<u4").tobytes())]


def test_one_id_fills_many_shards(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(400)], [7] * 300 + [None] * 100)
    bases = token_files.write_token_files(docs, f"file://{tmp_path}/hot", token_text.tokenizer_path("word_bpe_49k.json"), 2)
    assert len(bases) == 4 and max(n for _, n, _ in bases) < 250 and sum(n for _, n, _ in bases) == 400


@pytest.mark.parametrize("wide", [False, True])
def test_files_round_trip(spark, tmp_path, wide, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_CHARS", 500)
    texts = TEXTS + made()
    ids = [None if i == 3 else 2 * i for i in range(len(texts))]
    random.Random(0).shuffle(ids)
    folder = f"file://{tmp_path}/set"
    bases = token_files.write_token_files(frame(spark, texts, ids), folder, token_text.tokenizer_path("word_bpe_49k.json"), 2, wide=wide)
    got = sorted(map(tuple, token_files.read_token_files(spark, folder, bases, wide).collect()), key=lambda r: r[1])
    t, exp, start = library("word_bpe_49k.json"), [], 0
    for i, x in sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0])):
        out = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        exp.append((i, start, len(out), zlib.crc32(np.array(out, "<u4").tobytes())))
        start += len(out)
    assert got == exp
    empty = token_files.token_files(frame(spark, texts).limit(0), token_text.tokenizer_path("word_bpe_49k.json"), 2)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


# --- op5 ---

def grams(text, n):
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(max(len(ws) - n + 1, 1))} if ws else set()


def test_contained_items_equal_brute_force(spark):
    r = random.Random(4)
    texts = made(5, 80)
    items = [" ".join(t.split()[a : a + k]) for t in texts[:40] if len(t.split()) > 30 for a, k in [(r.randint(0, 9), r.randint(5, 40))]] + [None, "", "th er", "THER on"]
    docs = texts + EDGE
    items_frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.contained_items(frame(spark, docs), items_frame).collect()))
    exp = []
    for d, t in enumerate(docs):
        for i, q in enumerate(items):
            n = min(5, len(words(q)))
            s = grams(q, n) if n else set()
            k = len(s & grams(t, n)) if s and len(words(t)) >= n else 0
            if s and 100 * k >= 80 * len(s):
                exp.append((d, i, k, len(s)))
    assert got == sorted(exp) and exp
    assert {r.doc_id for r in decontaminate.keep_clean(frame(spark, docs), items_frame).collect()} == set(range(len(docs))) - {d for d, *_ in exp}
    assert decontaminate.contained_items(frame(spark, docs), items_frame.limit(0)).count() == 0


def test_scattered_items_are_found_in_any_number_of_blocks(spark, monkeypatch):
    """Recall of the window search: shingles of an item spread over a long document."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(r.randint(5, 60))] for _ in range(300)]
    docs = []
    for ws in items:
        parts, at = [], 0
        while at + 5 <= len(ws):  # pieces that hold all shingles, far apart
            n = r.randint(5, 9)
            parts.append(" ".join(ws[at : at + n]))
            at += n - 4
        r.shuffle(parts)
        docs.append(" ".join(x for p in parts for x in (p, " ".join(word() for _ in range(r.randint(0, 80))))))
    items_frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    n = lambda ws: len(grams(" ".join(ws), 5))
    exp = {(i, i, len(grams(" ".join(ws), 5) & grams(d, 5)), n(ws)) for i, (ws, d) in enumerate(zip(items, docs, strict=True))}
    exp = {x for x in exp if 100 * x[2] >= 80 * x[3]}
    got = set(map(tuple, decontaminate.contained_items(frame(spark, docs), items_frame).collect()))
    assert len(exp) > 250 and len(got & exp) >= 0.99 * len(exp) and got <= exp
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(decontaminate, "DOC_BYTES", 20_000)
    assert set(map(tuple, decontaminate.contained_items(frame(spark, docs), items_frame).collect())) == got
    clean = {x.doc_id for x in decontaminate.keep_clean(frame(spark, docs + ["clean one"]), items_frame).collect()}
    assert clean == set(range(len(docs) + 1)) - {x[0] for x in got}


# --- op6 ---

def brute_components(texts, n, percent):
    sets = [grams(t, n) for t in texts]
    to = list(range(len(texts)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, n, percent):
    texts = made(7, 90) + EDGE
    got = jaccard.jaccard_components(frame(spark, texts), n, percent).select("doc_id", "n_shingles", "component_id").orderBy("doc_id").collect()
    assert list(map(tuple, got)) == brute_components(texts, n, percent)


def test_jaccard_edges(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, ""], [None, 7, 7, None, 3])
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.n_shingles} == {7} and {r.component_id for r in got if not r.n_shingles} == {None, 3}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_connected_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (200, 201)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[start] == min(seen)
    assert set(got) == set(near)


# --- op7 ---

def labelled(r):
    plain, bad = [f"w{i}er" for i in range(200)], ["blarg", "snorfy", "kwepplen"]
    rows, labels = [], []
    for i in range(600):
        ws = [r.choice(plain) for _ in range(r.randint(20, 80))]
        y = int(i % 6 == 0)
        for _ in range(3 * y):
            ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append(" ".join(ws))
        labels.append((i, y))
    return rows, labels


def test_toxicity_on_held_out_labels(spark):
    rows, labels = labelled(random.Random(2))
    docs = frame(spark, rows + EDGE)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert len(got) == 600 + len(EDGE) and all(0 <= s <= 1 for s in got.values()) and max(got[i] for i in range(600, len(got))) < 0.5
    kept = {x.doc_id for x in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def brute_toxicity(text, ordinary, toxic, weights, offset):
    """A row scored without tables, parts or batches."""
    import math

    import zstandard

    size = lambda d, x: len(zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(x))
    gains = []
    for w in (text or "").lower().encode().split():
        w = w.strip(b".,;:!?()[]\"'")
        if w:
            gains.append(max(size(ordinary, (b" " + w[i : i + 24]) * 3 + b" ") - size(toxic, (b" " + w[i : i + 24]) * 3 + b" ") for i in range(0, len(w), 24)))
    x = [math.log1p(sum(g for g in gains if g >= t)) for t in (1, 2, 3, 4, 5)] + [max(0, min(16, max(gains, default=0))), math.log1p(len(gains))]
    return 1 / (1 + math.exp(-(offset + sum(a * b for a, b in zip(weights, x, strict=True)))))


def test_scores_of_a_fixed_model_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TABLE_ENTRIES", 300)
    monkeypatch.setattr(toxicity, "SEGMENT_CHARS", 100)
    rows, _ = labelled(random.Random(3))
    texts = rows[:30] + made()[:30] + EDGE
    words_ = [w for t in made() for w in t.encode().split()]
    ordinary, toxic = toxicity.trained([b" " + w + b" " for w in words_] * 20, 4096), b" blarg  snorfy  kwepplen "
    model = toxicity.Model(ordinary, toxic, (0.3, 0.2, 0.1, -0.2, 0.5, 0.25, -0.4), -0.7)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(spark, texts).repartition(3), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_toxicity(t, ordinary, toxic, model.weights, model.offset), abs=1e-9), t


# --- op8 ---

def test_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "Hello there\nsecond  line"), (1, 1, "b", "Other thing"), (1, 2, "a", "> hello THERE\n> second line\nMy answer\n"),
        (1, 3, "b", "> > Hello there\n> My answer\n\nfine"), (1, 4, "a", None), (2, 0, "x", "> Hello there\nelsewhere"), (None, None, "u", "text"), (2, 0, "x", "> Hello there\nelsewhere"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2].reply_to, got[1, 2].linked, got[1, 2].content, got[1, 2].quoted_lines) == (0, True, "My answer", 2)
    assert (got[1, 3].reply_to, got[1, 3].content, got[1, 3].max_level) == (2, "fine", 2)
    assert (got[1, 4].reply_to, got[1, 4].linked, got[1, 4].content) == (3, False, "") and got[1, 0].reply_to is None
    assert not got[2, 0].linked and got[2, 0].content == "elsewhere" and got[None, None].position == 0
    assert all(r.reply_to is None or r.reply_to < r.turn for r in got.values())


def test_quotes_over_slices(spark, sf):
    # a third of the rows in one conversation, turns far apart as time stamps are
    rows = [(1, 10**12 + 3_600_000 * t, "r", ("> common\n" if t % 3 == 2 else "") + ("common" if t % 3 == 0 else f"own {t}")) for t in range(200)]
    rows += [(c, 7 * t, "r", f"> own {t - 2}\nown {t}" if t > 1 else f"own {t}") for c in range(2, 42) for t in range(10)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    slices = quotes.in_slices(docs, ["conv_id"], "turn")
    assert slices.where("conv_id = 1").select("slice").distinct().count() > 1
    got = quotes.link_quotes(docs).collect()
    step = 3_600_000
    assert all(r.reply_to == r.turn - 2 * step for r in got if r.conv_id == 1 and (r.turn - 10**12) // step % 3 == 2)
    assert {(r.turn, r.branch) for r in got if r.conv_id == 2} == {(7 * t, 0 if t < 2 or t % 2 else 14) for t in range(10)}
    assert quotes.link_quotes(docs.limit(0)).count() == 0


def test_branches_follow_replies(spark):
    r = random.Random(8)
    rows = []
    for c in range(30):
        for t in range(25):
            to = r.randrange(t) if t else None
            rows.append((c, t, "r", (f"> line {to}\n" if t and r.random() < 0.6 else "") + f"line {t}"))
    got = {(x.conv_id, x.turn): x for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for (c, t), x in got.items():
        first = x.reply_to is not None and t == min(s for (d, s), y in got.items() if d == c and y.reply_to == x.reply_to)
        assert x.branch == (got[c, x.reply_to].branch if first else t)


def test_quotes_equal_sql_where_there_are_quotes(spark, as_rows):
    import duckdb

    rows = [(c, t, "r", "\n".join(random.Random(100 * c + t).choice(["> one", ">> two", "one", "two", " > Three ", "three", ""]) for _ in range(5))) for c in range(20) for t in range(8)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.register("conversations", docs.toPandas())
    assert as_rows(quotes.link_quotes(docs).toPandas()) == as_rows(c.sql(quotes.ORACLE).df())


# --- op9 ---

def test_url_aliases(spark, monkeypatch):
    rows = [
        (1, "http://a.org/es/1", '<link rel="canonical" href="http://b.org/x">'), (2, "http://b.org/x", ""), (3, "http://c.org/y", '<meta http-equiv=refresh content="0; url=/z">'),
        (4, "http://c.org/z", None), (5, None, "x"), (6, "nourl", ""), (7, "HTTP://B.org/x#f", ""), (8, "http://example.com/en/7", "<LINK href=http://b.org/x rel=canonical>"), (8, "http://example.com/en/7", ""),
        (9, "http://sub.example.com/en/8?x", ""), (10, "http://wexample.net/de/8", ""), (11, "https://example.net/de/8#a", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    redirects = spark.createDataFrame([("http://b.org/x", "http://c.org/y"), (None, "http://q.org/")], "from_url string, to_url string")
    show = lambda: sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in url_filter.url_filter(pages, redirects=redirects).collect())
    got = show()
    verdict = {r[0]: (r[2], r[3]) for r in got}
    assert len(got) == len(rows) and verdict == {
        1: ("org/es/", "block"), 2: ("", "block"), 3: ("", "block"), 4: ("", "block"), 5: ("", "allow"), 6: ("", "allow"), 7: ("", "block"),
        8: ("example.com/en/7", "allow"), 9: ("com/en/", "block"), 10: ("net/de/", "allow"), 11: ("example.net/de/8", "block"),
    }
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert show() == got
    assert url_filter.url_filter(pages.limit(0)).count() == 0


@pytest.mark.parametrize("inline", [0, 200])
def test_rules_of_equal_length(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    pages = spark.createDataFrame([(1, "http://a.b.com/xyz", None)], "page_id long, url string, html string")
    one = lambda *rules: tuple(url_filter.url_filter(pages, rules).select("rule", "verdict").first())
    assert one(("allow", "b.com", "/x"), ("allow", "com", "/xyz")) == ("b.com/x", "allow")
    assert one(("block", "b.com", "/x"), ("allow", "com", "/xyz")) == ("com/xyz", "allow")
    assert one(("block", "b.com", "/xy"), ("allow", "com", "/xyz")) == ("b.com/xy", "block")


def test_url_filter_runs_no_python(spark, sf):
    plan = url_filter.op9_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
