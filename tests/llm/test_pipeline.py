import collections

import corpus_pipeline as pipeline
from rowlens.llm.shingles import words

from .test_operators import EDGE, frame, grams, made


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_near_duplicates_leave_one_of_each_group(spark, sf):
    texts = made(11, 60) + ["", None]
    got = {r.doc_id for r in stage("near duplicates")(spark, frame(spark, texts), sf).collect()}
    sets = [grams(t, 5) for t in texts]
    near = lambda i, j: 10 * (o := len(sets[i] & sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - o)
    groups, left = [], set(range(len(texts)))
    while left:
        group = todo = {min(left)}
        while todo:
            todo = {j for i in todo for j in left - group if sets[i] and near(i, j)}
            group = group | todo
        groups.append(group)
        left -= group
    assert got == {min(g) for g in groups}


def test_mix_repeats_and_drops_documents(spark, sf):
    docs = frame(spark, [f"w{i} " * (i % 9 + 1) for i in range(300)])
    got = collections.Counter(r.doc_id for r in stage("mixing")(spark, docs, sf).collect())
    assert set(got.values()) <= {1, 2}
    total = sum((i % 9 + 1) * k for i, k in got.items())
    assert 0 <= 1.5 * sum(i % 9 + 1 for i in range(300)) - total <= 9


def test_columns_and_nulls_of_any_kind(spark, sf):
    rows = [(1, "x", None, "a"), (1, None, "x", "b"), (2, "y " * 30, "x", "c"), (None, "z", "x", "d"), (2, "", "x", "e"), (2, None, "x", "f")]
    names = "doc_id long, text string, source string, _row string, _times string, row string, times string, no long, h long, size long, mark long"
    docs = spark.createDataFrame([(i, t, s, k, k, k, k, 1, 2, 3, 4) for i, t, s, k in rows], names)
    for name in ("near duplicates", "mixing"):
        out = stage(name)(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {r.row: r for r in out.collect()}
        assert all(r._row == r._times == r.times == r.row for r in kept.values())
        assert ("b" in kept and "d" in kept and "f" in kept and "e" in kept) if name == "near duplicates" else "a" in kept


def test_stages_take_edge_rows(spark, sf):
    docs = frame(spark, EDGE + EDGE, [None, 1, 1, 2, 3, 4, 5, 6, 7, 8] * 2).drop("n")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() > 0


def test_empty_table(spark, sf):
    docs = frame(spark, EDGE).drop("n").limit(0)
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_equals_its_parts(spark, sf):
    from rowlens.llm import toxicity
    from rowlens.llm.common import table

    docs = table(spark, sf, "documents")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf, "labels"))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.5}
    items = [grams(r.text, 5) for r in table(spark, sf, "benchmark").collect()]
    got = pipeline.run(spark, sf).collect()
    ids = collections.Counter(r.doc_id for r in got)
    assert set(ids) <= set(texts) and set(ids.values()) <= {1, 2}
    assert not any(100 * len(s & grams(texts[i], 5)) >= 80 * len(s) for i in ids for s in items)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and min(len(words(texts[i])) for i in ids) > 0
