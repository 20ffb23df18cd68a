"""N-gram Jaccard join by vertical partitioning.

Shingles (by fingerprint) are cut into FRAGMENTS ranges of the global order of
fingerprints. Each range of every set, a segment, is a row of its own.

1. Texts become sets of fingerprints. The first fragments of every set are
   grouped by shingle. A shingle in the sets of one class of equal sets only
   can't be shared; a set with more of those than the similarity allows has
   no link and leaves. Grouping counts before it shuffles, so a passage that
   a third of all documents share is one row for each task.
2. The remaining classes of equal sets are read again, whole, and shingles of
   one class only leave them; they count in the sizes. A set keeps the number
   of its shingles in each fragment. Each class proposes the shingles of its
   prefix, in order of frequency, rarest first: two sets that link must share
   one of them.
3. Within a shingle's holders, pairs are not listed. A leader (one for each
   salt, more salts in each round; the holder with the fewest shingles of its
   own, as an original has among its copies) is compared with the holders that
   aren't yet in its component; those in one need no comparison any more.
   When all holders that have not led are in one component, every pair of
   different components has been compared and the shingle is done. So links
   are lost between no two components, and a group of n near copies costs
   about n comparisons. Rounds see components only through the links between
   the components of the round before; all links together give the result once.
4. A pair goes no further if its fragments can't overlap enough: in none more
   than the smaller segment. Else each fragment counts its own overlap, where
   the two segments meet, and the counts are summed for each pair and compared
   with the threshold exactly, in integers.

Where many holders of a shingle pass these bounds and yet link with none, each
of them must be compared with the others; only that case is more than linear.

Nothing here is a Python group: shuffles carry numbers of classes and
fingerprints, texts never move, and the one table that reaches all executors is
a Bloom filter of BLOOM_BITS bits that only saves work. Tables of the rounds are
in as many partitions as their rows need, and are deleted once superseded.

Null and empty texts have empty sets and link with nothing; equal and null ids
are separate rows, whose component is the smallest id in it (null if none);
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import bounded_batches, discard, few, stored, table
from rowlens.llm.components import components
from rowlens.llm.shingles import fingerprints, words

FRAGMENTS = 8
BLOOM_BITS = 1 << 26
BLOOM_KEYS = 3
#: Rarest shared shingles of each set that the first, cheap round looks at.
FIRST_KEYS = 2
#: Leaders of a shingle in the first full round, and how many times more each further one has.
FIRST_SALTS, MORE_SALTS = 8, 16


def _sets(texts: pa.Array, n: int):
    for t in texts:
        h = fingerprints(words(t.as_py()), n)
        yield np.unique(h) if len(h) > 1 else h


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _small(batch: pa.RecordBatch, rows: int = 2000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def shingle_sets(docs: DataFrame, n: int, id_col: str, text_col: str, probe: int) -> DataFrame:
    """(id, n, key, probe): set size, digest of the set, its shingles in the first fragments."""
    kind = docs.schema[id_col].dataType.simpleString()
    shift, most = np.uint64(64 - FRAGMENTS.bit_length() + 1), np.uint64(probe)

    def run(batches):
        for whole in batches:
            for batch in _small(whole):
                sizes, keys, parts = [], [], []
                for s in _sets(batch.column(1), n):
                    sizes.append(len(s))
                    keys.append(_key(s))
                    parts.append(s[(s >> shift) < most])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(parts)], names=["id", "n", "key", "probe"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, key binary, probe array<long>")


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of a column's xxhash64 values, BLOOM_BITS at most whatever the input."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(BLOOM_BITS)) for i in range(BLOOM_KEYS)]))
    cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits"))
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    for r in cells.toLocalIterator():
        out[r.cell] = r.bits
    return out


def _full_sets(docs: DataFrame, n: int, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(no, n, set) of the wanted classes, read from the texts once more."""
    ids = wanted.select("id").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bloom(ids, "id"))
    spots = [F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), F.lit(BLOOM_BITS)).alias(f"s{i}") for i in range(BLOOM_KEYS)]

    def run(batches):
        held = bits.value
        for whole in batches:
            for batch in _small(whole):
                hit = np.ones(batch.num_rows, bool)
                for i in range(BLOOM_KEYS):
                    s = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(np.int64)
                    hit &= (held[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1) == 1
                sets = list(_sets(batch.column(0).take(pa.array(np.flatnonzero(hit))), n))
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["key", "n", "set"])

    full = docs.select(F.col(text_col).alias("text"), *spots).mapInArrow(run, "key binary, n long, set array<long>")
    return full.join(wanted.select("key", "no"), "key").select("no", "n", "set").dropDuplicates(["no"])


def _fragment(h) -> F.Column:
    """The fragment of a fingerprint: its range in the unsigned order."""
    return F.shiftrightunsigned(h, 64 - FRAGMENTS.bit_length() + 1).cast("int")


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the threshold: overlaps are counted in each fragment, then summed by pair."""
    one = pairs.join(segments.select(F.col("no").alias("a"), "fragment", F.col("part").alias("part_a")), "a")
    both = one.join(segments.select(F.col("no").alias("b"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", "ca", "cb", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    total = partial.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.sum("overlap").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "ca", "cb")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, class_id) of every row.

    Sets of n-word shingles link at a Jaccard similarity of percent / 100;
    component_id is the smallest id reachable by links, class_id the digest
    shared by the rows of equal sets.
    """
    bounded_batches(docs.sparkSession)
    probe = min(FRAGMENTS, max(1, -(-FRAGMENTS * 16 * (100 - percent) // 1000)))
    rows = stored(shingle_sets(docs, n, id_col, text_col, probe), "jaccard-sets")
    filled = rows.where("n > 0")

    # 1: sets that share too little with any other in the first fragments
    seen = filled.select(F.xxhash64("key").alias("k"), F.explode("probe").alias("h"))
    lone = seen.groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("z")).where("k = z").groupBy("k").agg(F.count("*").alias("lone"))
    classes = filled.groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n")).withColumn("k", F.xxhash64("key"))
    rest = classes.join(lone, "k", "left").where(100 * (F.col("n") - F.coalesce("lone", F.lit(0))) >= percent * F.col("n"))
    rest = stored(rest.select("key", "id", F.monotonically_increasing_id().alias("no")), "jaccard-rest")

    # 2: whole sets of the rest without what no other class has, and their prefixes
    sets = stored(_full_sets(docs, n, id_col, text_col, rest), "jaccard-full")
    each = sets.select("no", F.explode("set").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "h").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))  # a set is one row already
    shared = shared.join(sets.select("no", "n"), "no").withColumn("shared", F.size("order")).where(100 * F.col("shared") >= percent * F.col("n"))
    inside = lambda f: F.filter("order", lambda x: _fragment(x.h) == f)
    sizes = F.array(*[F.size(inside(f)) for f in range(FRAGMENTS)])
    shared = stored(shared.select("no", "n", "shared", sizes.alias("sizes"), F.col("order.h").alias("order")), "jaccard-shared")
    discard(sets)
    least = F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int")
    prefix = F.slice("order", F.lit(1), F.col("shared") - least + 1)
    keys = shared.select("no", "n", "shared", "sizes", F.posexplode(prefix).alias("rank", "h"))
    part = lambda f: F.filter("order", lambda h: _fragment(h) == f)
    parts = F.array(*map(part, range(FRAGMENTS)))
    segments = shared.select("no", F.posexplode(parts).alias("fragment", "part")).where(F.size("part") > 0)

    # 3 and 4: leaders against holders outside their component, until none is left
    links, used = _connect(keys, stored(segments, "jaccard-segments"), percent)
    comp = components(links).select(F.col("node").alias("no"), F.col("component").alias("comp"))
    linked = rest.select("key", "id", "no").join(comp, "no")
    least_id = linked.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = linked.join(least_id, "comp").select("key", F.struct("component_id").alias("linked"))
    named = stored(classes.join(named, "key", "left").select("key", F.coalesce("linked.component_id", "id").alias("component_id")), "jaccard-names")
    discard(rest, shared, *used)
    out = rows.select("id", "n", "key").join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.hex("key").alias("class_id"))


def _connect(keys: DataFrame, segments: DataFrame, percent: int):
    """(links, tables used): enough of the links (a, b) to give the components of all."""
    # at the first shingle that two sets share, what comes before it in the
    # order can't overlap; a pair that shares an earlier one is looked at there
    enough = lambda o: 100 * o >= percent * (F.col("na") + F.col("nb") - o)
    bound = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.least(x, y)), F.lit(0), lambda n, k: n + k)
    columns = ["no", "n", "own", "h", "left", "sizes", "comp"]

    def lead(held: DataFrame, salts: int) -> DataFrame:
        salt = F.pmod(F.xxhash64("no"), F.lit(salts))
        return held.groupBy("h", salt.alias("salt")).agg(F.min(F.struct("own", "no", "n", "left", "sizes", "comp")).alias("l"))

    def candidates(held: DataFrame, leaders: DataFrame) -> DataFrame:
        l = leaders.select("h", F.col("l.no").alias("a"), F.col("l.n").alias("na"), F.col("l.left").alias("la"), F.col("l.sizes").alias("fa"), F.col("l.comp").alias("ca"))
        p = held.select("h", F.col("no").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("sizes").alias("fb"), F.col("comp").alias("cb")).join(l, "h")
        p = p.where((F.col("ca") != F.col("cb")) & enough(F.least("la", "lb")) & enough(bound))
        ends = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
        return p.select(*(ends(x, y) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("ca", "cb"), ("cb", "ca")))).distinct()

    held = keys.select("no", "n", (F.col("n") - F.col("shared")).alias("own"), "h", (F.col("shared") - F.col("rank")).alias("left"), "sizes", F.col("no").alias("comp"), "rank")
    held = stored(held, "jaccard-held")
    size, used, links, tried, salts = held.count(), [segments], None, None, 1
    while True:
        first = tried is None
        look = held.where(F.col("rank") < FIRST_KEYS) if first else held
        leaders = stored(few(lead(few(look, size), salts), size), "jaccard-leaders")
        fresh = candidates(few(look, size), few(leaders, size))
        fresh = stored(few(fresh if first else few(fresh, size).join(tried, ["a", "b"], "left_anti"), size), "jaccard-pairs")
        found = stored(_links(fresh, segments, percent), "jaccard-links")
        used += [fresh, found]
        links = found if first else links.unionByName(found)
        tried = fresh.select("a", "b") if first else tried.unionByName(fresh.select("a", "b"))
        # a shingle whose waiting holders are in one component stays so
        joined = components(found, "ca", "cb").select(F.col("node").alias("comp"), F.col("component").alias("to"))
        now = few(held, size).join(few(joined, size), "comp", "left").withColumn("comp", F.coalesce("to", "comp"))
        if not first:
            now = few(now, size).join(few(leaders.select("h", F.col("l.no").alias("no")), size), ["h", "no"], "left_anti")
        now = few(now, size).select(*columns, "rank")
        active = now.groupBy("h").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("h")
        waiting = stored(few(now.join(few(active, size), "h", "left_semi"), size), "jaccard-held")
        discard(held, leaders)
        held, size, salts = waiting, waiting.count(), FIRST_SALTS if first else salts * MORE_SALTS
        if not size:
            return links, [held, *used]


def op6_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, list_aggregate(ws[i:least(i + 3, len(ws))], 'string_agg', ' ') as g
  from w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as r(i) where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), f as (
  select g from s group by g having count(*) > 1
), t as (
  select s.* from s semi join f using (g)
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)
), e as (
  select a, b from l union select b, a from l
), c(node, seen) as (
  select doc_id, doc_id from documents union select c.node, e.b from c join e on e.a = c.seen
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(seen) from c where c.node = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id
"""
