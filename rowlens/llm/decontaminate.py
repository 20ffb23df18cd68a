"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of a whole document says
nothing about an item inside it. Items are therefore partitioned by the size
of their shingle sets; for a partition with items of at most u shingles a
document is read in windows of 2u shingles that advance by u, and an item that
lies together is whole in one of them. Within a partition the containment
threshold becomes a Jaccard threshold of about 0.26 or more, for which HASHES
bands of one minimum each miss an item with a probability below 1e-6.

With one minimum to a band, a collision means that the window holds the very
shingle of the item that is least under that hash function; windows without
such a shingle are passed over at no loss. Candidates are verified by exact
containment of the item's shingle set in that of the whole document.

A Spark job deals items into blocks of about BLOCK_SHINGLES shingles, which stay
in files of the shared folder. A task reads one block at a time, builds its
index and looks at DOC_BYTES of documents with it, so what a task holds is
bounded; documents never move, and items never reach the driver. An item with fewer than n words is one shingle
of all its words and is sought as such. Null and empty texts match nothing.
Repeated rows and equal or null ids are separate; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import file_system, fresh_path, table, word_count
from rowlens.llm.shingles import _mix, fingerprints, words

HASHES = 48
BLOCK_SHINGLES = 1_000_000
#: Bytes of documents that a task looks at with one block after the other.
DOC_BYTES = 32 << 20
_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Index:
    """Signatures of one block of items, by size partition."""

    def __init__(self, items: list[tuple], n: int, percent: int):
        self.n, self.percent = n, percent
        self.items = [(i, *_item(text, n)) for i, text in items]
        self.items = [x for x in self.items if len(x[1])]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.classes: dict[int, dict[tuple[int, int], list[int]]] = {}
        marks = []
        for at, (_, s, m) in enumerate(self.items):
            if m < n:
                self.short.setdefault(m, {}).setdefault(int(s[0]), []).append(at)
                continue
            size = 1
            while size < len(s):  # partitions end at 1, 2, 3, 4, 6, 8, 12, 16 ...
                size = size * 3 // 2 if size > 1 and size & (size - 1) == 0 else (size * 4 // 3 if size > 1 else 2)
            least = _mix(s[:, None] ^ _SEEDS)
            where = least.argmin(0)
            marks.append(s[where])
            band = self.classes.setdefault(size, {})
            for k, j in enumerate(where):
                band.setdefault((k, int(least[j, k])), []).append(at)
        self.marks = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)

    def candidates(self, h: np.ndarray) -> set[int]:
        if not len(self.marks) or not len(h):
            return set()
        at = np.searchsorted(self.marks, h)
        at[at == len(self.marks)] = 0
        hits = np.flatnonzero(self.marks[at] == h)
        found: set[int] = set()
        for u, band in self.classes.items() if len(hits) else ():
            starts = np.unique(np.concatenate([hits // u, np.maximum(hits // u - 1, 0)])) * u
            for a in starts:
                least = _mix(h[a : a + 2 * u, None] ^ _SEEDS).min(0)
                for k, v in enumerate(least.tolist()):
                    got = band.get((k, v))
                    if got:
                        found.update(got)
        return found

    def matches(self, text: str | None):
        """(item id, shared, size) of the items that the text contains."""
        ws = words(text)
        h = fingerprints(ws, self.n)
        whole = None
        for at in sorted(self.candidates(h)):
            whole = np.unique(h) if whole is None else whole
            i, s, _ = self.items[at]
            shared = int(np.isin(s, whole, assume_unique=True).sum())
            if 100 * shared >= self.percent * len(s):
                yield i, shared, len(s)
        for m, held in self.short.items():
            if len(ws) >= m:
                for v in np.intersect1d(fingerprints(ws, m), np.array(list(held), np.uint64)).tolist():
                    for at in held[v]:
                        yield self.items[at][0], 1, 1


def _item(text: str | None, n: int):
    ws = words(text)
    return np.unique(fingerprints(ws, n)), min(len(ws), n)


class Blocks:
    """Items in numbered blocks of files; a worker keeps the index that it built last."""

    _kept: dict = {}

    def __init__(self, items: DataFrame, n: int, percent: int):
        """items: (item, text)."""
        spark = items.sparkSession
        size = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
        self.n, self.percent, self.count, self.path = n, percent, max(1, -(-size // BLOCK_SHINGLES)), fresh_path(spark, "benchmark-items")
        dealt = items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(self.count)))
        dealt.repartition("block").write.partitionBy("block").parquet(self.path)

    def index(self, block: int) -> Index:
        key = self.path, block
        if key not in self._kept:
            fs, at = file_system(f"{self.path}/block={block}")
            from pyarrow.fs import FileSelector

            held = []
            for info in fs.get_file_info(FileSelector(at, allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with fs.open_input_file(info.path) as f:
                        t = pq.ParquetFile(f).read()
                    held.extend(zip(t.column("item").to_pylist(), t.column("text").to_pylist(), strict=True))
            self._kept.clear()
            self._kept[key] = Index(held, self.n, self.percent)
        return self._kept[key]

    def each(self, batches, text_at: int):
        """(batch, index) of every batch with every block."""
        held, size = [], 0

        def looked():
            for block in range(self.count):
                index = self.index(block)
                for batch in held:
                    yield batch, index

        for batch in batches:
            held.append(batch)
            size += batch.column(text_at).nbytes
            if self.count == 1 or size >= DOC_BYTES:
                yield from looked()
                held, size = [], 0
        yield from looked()


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, shared, item_shingles): each item that a document contains."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    schema = f"id {kind}, item {item_kind.simpleString()}, shared long, size long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind.simpleString(), pa.string())
    blocks = Blocks(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), n, percent)

    def run(batches):
        for batch, index in blocks.each(batches, 1):
            at, item, shared, size = [], [], [], []
            for j, t in enumerate(batch.column(1)):
                for i, k, q in index.matches(t.as_py()):
                    at.append(j)
                    item.append(i)
                    shared.append(k)
                    size.append(q)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, arrow), pa.array(shared, pa.int64()), pa.array(size, pa.int64())], names=["id", "item", "shared", "size"])

    found = rows.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "shared", F.col("size").alias("item_shingles"))


def keep_clean(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that contain no item, unchanged."""
    at = docs.columns.index(text_col)
    blocks = Blocks(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), n, percent)

    def run(batches):
        clean: dict[int, list] = {}  # batches under way: the batch, what is clean in it, blocks seen
        for batch, index in blocks.each(batches, at):
            held = clean.setdefault(id(batch), [batch, [True] * batch.num_rows, 0])
            held[1] = [ok and next(index.matches(t.as_py()), None) is None for ok, t in zip(held[1], batch.column(at), strict=True)]
            held[2] += 1
            if held[2] == blocks.count:
                del clean[id(batch)]
                yield batch.filter(pa.array(held[1], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: For items of five words or more.
ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') as g from w, unnest(range(1, len(ws) - 3)) as r(i)
), v as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from benchmark
), b as (
  select distinct item_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') as g from v, unnest(range(1, len(ws) - 3)) as r(i)
), n as (
  select item_id, count(*) as n from b group by item_id
)
select s.doc_id, b.item_id, count(*)::bigint as shared, any_value(n.n)::bigint as item_shingles
from s join b using (g) join n on n.item_id = b.item_id group by s.doc_id, b.item_id having 100 * count(*) >= 80 * any_value(n.n)
"""
