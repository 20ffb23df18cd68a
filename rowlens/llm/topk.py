"""Exact top-k inner products over norm-bucketed integer vectors.

Components become floor(256 * x). Vectors are range-partitioned and sorted by
descending length, so each Arrow batch of a partition is a bucket of vectors
of like length. For a query with a lower bound on its k-th score, a bucket
has a local cosine threshold: bound / (query length * longest vector in the
bucket). Above 1 the bucket is skipped. A high threshold takes coordinate
pruning: on the query's largest coordinates only a known interval of the
normalised vectors can reach it. Otherwise length pruning takes the head of
the bucket that is long enough. What is left is verified by exact products.

Queries are quantised by a Spark job, which also gives them first bounds from
the SEED longest vectors, and stay in files of the shared folder. A task holds
one partition of vectors (about PART_BYTES) and reads them in blocks of
QUERY_BLOCK, each block against all its buckets; neither queries nor results
pass through the driver. A partition returns at most k rows for a query, and a
window keeps each query's best.

Null and empty vectors, vectors with null or non-finite components and rows
without an id take no part; only vectors of the query's dimension are its
candidates; rows with the query's id are never its candidates, other equal ids
are separate rows. Products beyond 2**53 are computed with Python integers.
Scores are 64-bit: a component of 2**62 or more after scaling, or a score
outside 64 bits that can't be pruned, ends the query with an error, for no
whole answer could be given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import file_system, stored, table

QUERY_BLOCK = 4096
SEED = 2048
#: Bytes of quantised vectors in a partition.
PART_BYTES = 32 << 20
#: Local thresholds from which coordinates prune better than lengths.
COORDINATE_FROM = 0.6
FOCUS = 4
EXACT = float(1 << 53)
LARGEST = float(1 << 62)


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, q array<long>, dim, norm) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    good = F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))), F.lit(False))
    q = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(good & F.col("id").isNotNull())
    large = F.raise_error(F.lit("a vector component is too large for 64-bit scores")).cast("long")
    q = q.select("id", F.transform("x", lambda v: F.when(F.abs(v) < LARGEST / scale, F.floor(v * scale).cast("long")).otherwise(large)).alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return q.select("id", "q", F.size("q").alias("dim"), norm.alias("norm"))


def _products(m: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """m @ q for integers, exactly; most: a bound on the products."""
    if most < EXACT:
        return (m.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    try:
        return (m.astype(object) @ q.astype(object)).astype(np.int64)
    except OverflowError:
        raise ValueError("an inner product is outside 64 bits") from None


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int):
    """The k best of one bucket: higher score, then smaller id."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[order], scores[order]
    return ids, scores


class _Bucket:
    """Vectors of one dimension and like length, longest first."""

    def __init__(self, part: pd.DataFrame):
        part = part.sort_values("norm", ascending=False, kind="stable")
        self.ids, self.norm = part["id"].to_numpy(np.int64), part["norm"].to_numpy()
        self.m = np.stack(part["q"].to_list())
        self._unit = None

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.m / np.where(self.norm > 0, self.norm, 1)[:, None]
        return self._unit


def _search(buckets: list[_Bucket], qid, qm, qn, low, k: int):
    """(query ids, ids, scores): each query's k best of a partition, if they may be among its best."""
    top: dict = {}
    found = []
    for bucket in buckets:
        longest = bucket.norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qn * longest > 0, low / (qn * longest), np.where(low > 0, np.inf, -np.inf))
        exact = qn.max() * longest < EXACT
        mf = bucket.m.astype(np.float64) if exact else None
        for i in np.flatnonzero(local <= 1 + 1e-9):
            t = local[i]
            if t >= COORDINATE_FROM:
                unit, u = bucket.unit, qm[i] / qn[i]
                keep = np.ones(len(bucket.ids), bool)
                for f in np.argsort(-np.abs(u))[:FOCUS]:
                    reach = np.sqrt(max(0.0, 1 - min(t, 1) ** 2) * max(0.0, 1 - u[f] ** 2))
                    keep &= np.abs(unit[:, f] - u[f] * min(t, 1)) <= reach + 1e-6 if u[f] ** 2 <= t * t else (unit[:, f] * np.sign(u[f]) >= np.abs(u[f]) * t - reach - 1e-6)
                at = np.flatnonzero(keep)
            elif t > 0:
                at = slice(0, int(np.searchsorted(-bucket.norm, -(low[i] / qn[i]) * (1 - 1e-9), side="right")))
            else:
                at = slice(None)
            s = (mf[at] @ qm[i].astype(np.float64)).astype(np.int64) if exact else _products(bucket.m[at], qm[i], EXACT)
            got, s = _best(bucket.ids[at][s >= low[i]], s[s >= low[i]], qid[i], k)
            if not len(s):
                continue
            held = np.sort(np.concatenate([top.get(i, np.array([], np.int64)), s]))[-k:]
            top[i] = held
            if len(held) == k and held[0] > low[i]:
                low[i] = held[0]
            found.append((np.full(len(s), i), got, s))
    if not found:
        return None
    at, ids, scores = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    rank = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    keep = rank < k
    return qid[at[keep]], ids[keep], scores[keep]


def _bounds(qid, qm, qn, seeds: list[dict], k: int) -> np.ndarray:
    """Lower bounds of the queries' k-th scores from some vectors."""
    low = np.full(len(qid), -(1 << 63), np.int64)
    near = [s for s in seeds if s["dim"] == qm.shape[1]]
    if len(near) > k:
        ids, m = np.array([s["id"] for s in near], np.int64), np.array([s["q"] for s in near], np.int64)
        most = float(qn.max() * max(s["norm"] for s in near))
        for i in range(len(qid)):
            s = _products(m, qm[i], most)[ids != qid[i]]
            if len(s) >= k:
                low[i] = np.partition(s, len(s) - k)[len(s) - k]
    return low


def _by_dim(frame: pd.DataFrame):
    """(part, ids, matrix, lengths) of the rows of each dimension."""
    for _, part in frame.groupby("dim", sort=False):
        yield part, part["id"].to_numpy(np.int64), np.stack(part["q"].to_list()), part["norm"].to_numpy()


def _blocks(files: list[str]):
    """Blocks of queries from the files of the shared folder."""
    for path in files:
        fs, at = file_system(path)
        with fs.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(QUERY_BLOCK):
                yield batch.to_pandas()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors; ties to smaller ids."""
    spark = vectors.sparkSession
    size = 8 * (vectors.agg(F.sum(F.greatest(F.size(vec_col), F.lit(0)))).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    v = quantised(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())  # keeps repeated rows apart
    v = stored(v.repartitionByRange(parts, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id").drop("row"), "topk-vectors")
    seeds = [r.asDict() for r in v.orderBy(F.desc("norm"), "id").limit(SEED).collect()]

    def bound(frames):
        for frame in frames:
            for part, qid, qm, qn in _by_dim(frame):
                yield part.assign(low=_bounds(qid, qm, qn, seeds, k))

    files = stored(quantised(queries, id_col, vec_col).mapInPandas(bound, "id long, q array<long>, dim int, norm double, low long"), "topk-queries").inputFiles()

    def search(frames):
        buckets: dict = {}
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=False):
                buckets.setdefault(dim, []).append(_Bucket(part))
        for block in _blocks(files) if buckets else ():
            for part, qid, qm, qn in _by_dim(block):
                if (dim := qm.shape[1]) in buckets:
                    got = _search(buckets[dim], qid, qm, qn, part["low"].to_numpy(np.int64).copy(), k)
                    if got:
                        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    found = v.mapInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, v.where("vec_id % 50 = 0"))


ORACLE = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from p
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
