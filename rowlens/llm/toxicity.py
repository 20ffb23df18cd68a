"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer, one on
ordinary and one on toxic labelled text. A text is cut into windows, each
window is compressed with both, and what the toxic dictionary saves over the
ordinary one is its gain. The sums of the gains that reach each of THRESHOLDS,
the largest gain and the number of windows go through a logistic curve, which
gives the score. The curve is shifted so that an even score is where the shares
of toxic texts above it and of ordinary texts below it have the largest sum.

A window is a word in lower case without punctuation around it; longer ones are
looked at in pieces of PIECE bytes, of which the largest gain counts. In windows
of several words the chance differences of the ordinary words hide what one
toxic word saves. A window is written REPEAT times, since zstandard stores a
block raw that saves next to nothing, and compressed at LEVEL, whose parse is
optimal: faster levels miss matches by chance.

Labels mark whole texts, and most words of a toxic text are ordinary. The
windows that the toxic dictionary is trained on are therefore those of toxic
texts whose word, or its START first letters, is TOXIC_RATIO times likelier
there than in ordinary texts. Document frequencies are those of a bounded sample
of labelled documents (distinct texts, SAMPLE_TOXIC and SAMPLE_ORDINARY rows at
most, chosen by a digest of the id); each dictionary is trained by one task on at
most TOXIC_WORDS or ORDINARY_WORDS words, and only its bytes come to the driver. The curve is fitted on a part of
the sample that the dictionaries have not seen; rows of a class that the sample
cuts short weigh more by as much, so the curve is the same at any size.

Scores never use labels, language, source or id of a row. Null and empty texts
have no windows and get the curve's score for none; without labels of both kinds
every score is 0. Repeated rows and equal ids each give a row; further columns
are ignored. Long texts are looked at in parts.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import bounded_batches, stored, table
from rowlens.llm.token_text import segments

SAMPLE_TOXIC, SAMPLE_ORDINARY = 12_000, 24_000
#: Words that the dictionaries are trained on, and how often one counts at most.
TOXIC_WORDS, ORDINARY_WORDS, WORD_TIMES = 20_000, 100_000, 100
#: Bytes of the dictionaries; the trainer makes smaller ones from little text.
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 110 << 10
#: A word or start that marks toxic text: in so many toxic texts at least, and so many times likelier there.
TOXIC_TEXTS, TOXIC_RATIO = 5, 40.0
START = 4
PIECE, REPEAT, LEVEL = 24, 3, 19
SEGMENT, DMER = 16, 6
SEGMENT_CHARS = 1 << 20
THRESHOLDS = (1, 2, 3, 4, 5)
#: Windows whose gains a worker keeps.
TABLE_ENTRIES = 150_000

_PUNCTUATION = b".,;:!?()[]\"'"


def tokens(text: str | None):
    """Lists of the blank-separated words of a text, one for each part of it."""
    for part in segments(text, SEGMENT_CHARS) if text else ():
        yield part.lower().encode("utf-8", "surrogatepass").split()


def words(text: str | None) -> set[bytes]:
    """Distinct words and their pieces, as windows hold them."""
    out = set()
    for ws in tokens(text):
        out.update(p for w in set(ws) for p in pieces(w))
    return out


def pieces(token: bytes) -> list[bytes]:
    w = token.strip(_PUNCTUATION)
    return [w[i : i + PIECE] for i in range(0, len(w), PIECE)]


def start(word: bytes) -> bytes | None:
    """The first letters of a longer word."""
    text = word.decode("utf-8", "replace")
    return text[:START].encode() if len(text) > START else None


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary from the trainer; from too little text, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Scorer:
    """Gains of windows under two dictionaries, kept for words seen before."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [self._compressor(d or b"\0" * 8) for d in (ordinary, toxic)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def gain(self, token: bytes) -> int | None:
        """Bytes that the toxic dictionary saves on a word; None for mere punctuation."""
        ordinary, toxic = self.pair
        found = [(b" " + w) * REPEAT + b" " for w in pieces(token)]
        return max((len(ordinary(x)) - len(toxic(x)) for x in found), default=None)

    def features(self, text: str | None) -> list[float]:
        """[sum of the gains that reach t, for each threshold t], largest gain, windows."""
        sums, most, n = dict.fromkeys(THRESHOLDS, 0), 0, 0
        for ws in tokens(text):
            new = [w for w in set(ws) if w not in self.known]
            if len(self.known) + len(new) > TABLE_ENTRIES:
                self.known.clear()
                new = set(ws)
            for w in new:
                self.known[w] = self.gain(w)
            got = [g for g in map(self.known.__getitem__, ws) if g is not None]
            n += len(got)
            got = [g for g in got if g > 0]
            most = max(most, *got) if got else most
            for t in THRESHOLDS:
                sums[t] += sum(g for g in got if g >= t)
        return [*(math.log1p(s) for s in sums.values()), float(min(most, 16)), math.log1p(n)]


_scorers: dict[bytes, Scorer] = {}


class Model:
    """Two dictionaries and a curve; small enough for a closure."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", weights=(), offset: float = -math.inf):
        self.ordinary, self.toxic, self.weights, self.offset = ordinary, toxic, tuple(weights), offset

    def scorer(self) -> Scorer:
        """The scorer of these dictionaries, kept by a Python worker from task to task."""
        key = xxhash.xxh3_128_digest(len(self.ordinary).to_bytes(8, "little") + self.ordinary + self.toxic)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(self.ordinary, self.toxic)
        return _scorers[key]

    def score(self, text: str | None) -> float:
        if self.offset == -math.inf:
            return 0.0
        z = self.offset + sum(a * b for a, b in zip(self.weights, self.scorer().features(text), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2):
    """Weights and, last, the offset by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(a.shape[1]), np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(hold)
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + hold * w)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _even(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of z at which the shares of toxic texts above and ordinary ones below it have the largest sum."""
    order = np.argsort(z, kind="stable")
    below = np.cumsum(y[order] == 0) / (y == 0).sum() - np.cumsum(y[order] == 1) / (y == 1).sum()
    i = int(below[:-1].argmax())
    return float(z[order][i : i + 2].mean())


def fold(id_col) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def _word_table(texts: DataFrame) -> DataFrame:
    """(word, start, t, o): toxic and ordinary texts that hold a word."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [sorted(words(t.as_py())) for t in part.column(0)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                held = pa.array([w for s in sets for w in s], pa.binary())
                starts = pa.array([start(w) for s in sets for w in s], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(ends), held), pa.ListArray.from_arrays(pa.array(ends), starts)], names=["y", "words", "starts"])

    each = texts.mapInArrow(run, "y int, words array<binary>, starts array<binary>").select("y", F.explode(F.arrays_zip("words", "starts")).alias("w"))
    return each.groupBy(F.col("w.words").alias("word"), F.col("w.starts").alias("start")).agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))


def _dictionary(words: DataFrame, size: int) -> bytes:
    """A dictionary trained by one task on a bounded table (word, n): a word counts n times, up to WORD_TIMES.

    The trainer takes something from each stretch of its input, so the order is mixed.
    """
    def run(batches):
        samples: list[bytes] = []
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples.extend([b" " + w + b" "] * min(n, WORD_TIMES))
        random.Random(0).shuffle(samples)
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples, size)], pa.binary())], names=["dictionary"])

    got = words.mapInArrow(run, "dictionary binary").collect()
    return b"".join(bytes(r.dictionary) for r in got)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows outside fold 0."""
    bounded_batches(docs.sparkSession)
    known = labels.where((fold(id_col) != 0) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    whole = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    take = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    sample = take(1, SAMPLE_TOXIC).unionByName(take(0, SAMPLE_ORDINARY)).withColumn("seen", fold(id_col) != 4)
    sample = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)  # SAMPLE_* rows at most
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).where("text is not null")
    rows = rows.groupBy(F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("y").alias("y"), F.min("seen").alias("seen"))
    rows = stored(rows.select("text", F.col("y").cast("int").alias("y"), "seen"), "toxicity-sample")

    learned = rows.where("seen").select("text", "y")
    n = {r.y: r["count"] for r in learned.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    df = stored(_word_table(learned), "toxicity-words")
    marks = lambda d: d.where((F.col("t") >= TOXIC_TEXTS) & (F.col("t") / n[1] > TOXIC_RATIO * (F.col("o") + 0.5) / n[0]))
    starts = marks(df.where("start is not null").groupBy("start").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))).select("start", F.lit(True).alias("marked"))
    marked = df.join(F.broadcast(starts.limit(TOXIC_WORDS)), "start", "left")
    own = (F.col("t") >= TOXIC_TEXTS) & (F.col("t") / n[1] > TOXIC_RATIO * (F.col("o") + 0.5) / n[0])
    toxic = marked.where((F.col("t") > 0) & (own | F.coalesce("marked", F.lit(False)))).orderBy(F.desc("t"), "word").limit(TOXIC_WORDS).select("word", F.col("t").alias("n"))
    plain = df.where("o > 0").orderBy(F.desc("o"), "word").limit(ORDINARY_WORDS).select("word", F.col("o").alias("n"))
    model = Model(_dictionary(plain, ORDINARY_BYTES), _dictionary(toxic, TOXIC_BYTES))

    def measure(batches):
        scorer = model.scorer()
        for batch in batches:
            found = [scorer.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.where("not seen").select("text", "y").mapInArrow(measure, "y int, x array<double>").collect()  # SAMPLE_* rows at most
    got = sorted((r.y, r.x) for r in got)
    y = np.array([r[0] for r in got], float)
    if 0 < y.sum() < len(y):
        short = {1: whole[1] / min(whole[1], SAMPLE_TOXIC), 0: whole[0] / min(whole[0], SAMPLE_ORDINARY)}
        weight = np.where(y == 1, short[1], short[0])
        x = np.array([r[1] for r in got])
        w = _logistic(x, y, weight)
        model.weights, model.offset = tuple(map(float, w[:-1])), float(w[-1] - _even(x @ w[:-1] + w[-1], y))
    else:  # too few labels to fit a curve: about two toxic words make an even score
        model.weights = (0.0, 4.0, *[0.0] * len(THRESHOLDS))
        model.offset = -4.0 * math.log1p(2 * THRESHOLDS[1])
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                scores = [model.score(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows whose score is below a bound, unchanged."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [model.score(t.as_py()) < below for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
