"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes over it also starts in a document with
a smaller id. Suffixes are sorted into buckets by their first q-gram; buckets
are refined by sorting on the bucket identifiers of later offsets, which are
reused from round to round: the identifier of 20 bytes (the q-gram's) and that
20 bytes on give one for 40, and that one and the one 10 bytes on give one for
50, where refinement ends. Identifiers are names that depend on the bytes alone
(80 bits where strings are told apart, 64 inside a bucket of equal q-grams), so
they are the same in all tasks and are never looked up.

Sorting all suffixes of a corpus is out of reach, so buckets are first built for
sampled suffixes, and only what stays open there goes on to all:

1. Initial buckets. Each string of LENGTH bytes has an anchor, the least of
   its q-grams by identifier (q = GRAM); equal strings have equal anchors.
   Strings in a row that share an anchor form a run, about one for 16 bytes of
   text. Runs with the same anchor gram are a bucket. A bucket with runs from
   one document only is settled: nothing in it starts elsewhere.
2. Refinement of runs. A bucket is sorted on the identifiers of the 50 bytes at
   the offsets of the run's first and last string; together they cover the run.
   Runs that equal one in a smaller document are settled, all their strings go.
   If a bucket still has several kinds of runs, the first document of each kind
   stays open.
3. Refinement of strings. All suffixes that start in open runs are sorted on
   their identifiers of 50 bytes; those with a smaller document go. These
   pointers, and those of step 2, update the documents' masks, from which the
   bytes are cut.

Within each batch every round is run first: one representative of a bucket
leaves a batch, and what is settled there is passed through. So a passage that
a third of all documents share is one entry of some 40 bytes for each batch of
BATCH_BYTES. Runs and strings travel as packed arrays, byte planes that compress,
runs about a sixteenth as many as bytes; a fragment of the order of identifiers is one group, and the
number of fragments grows with the input. Texts with open or settled runs are
shuffled once, by row, and kept in buckets of rows, where the strings meet them.
Each of these steps ends in a stored table and deletes its shuffle files then.

Texts are UTF-8 bytes, null is empty, matches never cross documents. Rows with
equal ids don't remove from each other; rows without an id keep all and remove
from none; further columns are ignored; long texts are handled in pieces.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import discard, fresh_path, shuffles_removed, stored, table
from rowlens.llm.shingles import _mix
from rowlens.llm.token_text import slabs

LENGTH, GRAM = 50, 20
#: Strings that start in one piece of a text.
PIECE = 1 << 15
#: Bytes of pieces that are looked at together; a place in them has 16 bits.
CHUNK = 1 << 16
#: Bytes of text whose runs make one fragment.
FRAGMENT_BYTES = 6 << 20
#: Bytes of text, and open strings, whose runs and strings make one batch. Each batch sends an entry to nearly every
#: fragment, so small batches would send little but entries once there are many fragments.
BATCH_BYTES, HELD_STRINGS = 8 << 20, 200_000
#: Bytes of text that a Python worker cuts at a time.
HELD_BYTES = 3 << 20

#: Multipliers of names: of bytes in a gram, and of the parts of a pair.
_BASE, _PAIR, _OTHER = 0x9E3779B97F4A7C15, np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_OPEN = 1 << 15  # in a run's number: its bucket has several kinds of runs in the batch


def grams(x: np.ndarray) -> np.ndarray:
    """Initial bucket identifiers: names of the GRAM bytes from each position on."""
    h = _BYTES[x]
    four = None
    for k in (1, 2, 4, 8):
        more = h[k:] * np.uint64(pow(_BASE, k, 1 << 64))
        more += h[:-k]
        h, four = more, more if k == 2 else four
    last = four[16:] * np.uint64(pow(_BASE, 16, 1 << 64))
    last += h[:-4]
    return _mix(last)


def refined(own: np.ndarray, later: np.ndarray, by: np.uint64 = _PAIR) -> np.ndarray:
    """Identifiers by pairs of the own one and the one at a later offset."""
    return _mix(_mix(own) * by + later)


def pointers(g: np.ndarray, at: np.ndarray, by: np.uint64 = _PAIR) -> np.ndarray:
    """Identifiers of LENGTH bytes at places, from those of GRAM bytes: 20, then 40, then 50."""
    step = LENGTH - 2 * GRAM
    forty = refined(g[at], g[at + GRAM], by)
    return refined(forty, refined(g[at + step], g[at + step + GRAM], by), by)


class Runs:
    """Pieces laid end to end: identifiers of their grams, and the runs of each piece in turn.

    lo, hi: first and last string of a run; anchor, rel: its anchor's identifier
    and place in the first string; base: where pieces start; first: number of
    the first run of each piece, and of all runs.
    """

    def __init__(self, raws: list[bytes]):
        ends = np.cumsum([len(r) for r in raws])
        self.base = np.concatenate([[0], ends[:-1]])
        self.g = g = grams(np.frombuffer(b"".join(raws), np.uint8))
        width = LENGTH - GRAM + 1
        m = g & ~np.uint64(0xFFFF)
        m |= np.arange(len(g), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(g) - width + 1], m[width - 16 :])
        m &= np.uint64(0xFFFF)
        at = m.view(np.int64)
        at[(ends[:-1, None] - np.arange(1, LENGTH)).ravel()] = -1  # strings that would go on in the next piece
        lo = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(at) - 1]])
        inside = at[lo] >= 0
        self.lo, self.hi = lo[inside], hi[inside]
        place = at[self.lo]
        self.anchor, self.rel = g[place], place - self.lo
        self.first = np.concatenate([np.searchsorted(self.lo, self.base), [len(self.lo)]])

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def chunks(pieces):
    """(tags, runs) of pieces (tag, bytes), as many at a time as CHUNK bytes hold."""
    tags, raws, n = [], [], 0
    for tag, raw in pieces:
        if raws and n + len(raw) > CHUNK:
            yield tags, Runs(raws)
            tags, raws, n = [], [], 0
        tags.append(tag)
        raws.append(raw)
        n += len(raw)
    if raws:
        yield tags, Runs(raws)


def pieces(raw: bytes):
    """(number, bytes) of the pieces of a text that hold a string."""
    for k, start in enumerate(range(0, max(len(raw) - LENGTH + 1, 0), PIECE)):
        yield k, raw[start : start + PIECE + LENGTH - 1]


def _settle(q, b, doc, open_):
    """Rounds 1 and 2 over runs: masks (goes, stays open, representative).

    q, b: anchor and content hashes; doc: ranks or ids; open_: runs of a bucket
    known to have several kinds.
    """
    order = np.lexsort((doc, b, q))
    q, b, doc, open_ = q[order], b[order], doc[order], open_[order]
    n = len(q)
    new_q = np.concatenate([[True], q[1:] != q[:-1]])
    new_b = new_q | np.concatenate([[True], b[1:] != b[:-1]])
    bucket, kind = np.cumsum(new_q) - 1, np.cumsum(new_b) - 1
    least_b = doc[new_b][kind]  # sorted by doc inside a kind
    starts = np.flatnonzero(new_q)
    least_q, most_q = np.minimum.reduceat(doc, starts)[bucket], np.maximum.reduceat(doc, starts)[bucket]
    kinds = np.add.reduceat(new_b.astype(np.int64), starts)[bucket]
    several = ((kinds > 1) & (least_q < most_q)) | np.logical_or.reduceat(open_, starts)[bucket]
    owner = doc == least_b
    goes, stays = ~owner, owner & several
    # the first kind of the smallest document stands for the bucket; a bucket
    # of one document goes on whole, for nothing in it is compared here
    first = np.full(starts.shape, np.iinfo(np.int64).max)
    np.minimum.at(first, bucket[owner & (doc == least_q)], kind[owner & (doc == least_q)])
    rep = (owner & (kind == first[bucket])) | (least_q == most_q)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return goes[back], stays[back], rep[back], several[back]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their lengths, byte by byte: all first bytes, then all second ones; their types are known to the reader.

    Ids, places and counts are small or near their neighbours, so most of their
    bytes are alike and shuffles compress them away; as whole numbers they don't.
    """
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *planes])


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, "<u8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * wide
    return out


def _stretches(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first is one."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


#: A fragment's runs: anchors, contents and numbers, then the rows and pieces that hold them in turn.
_RUNS = ("<u4", "<u8", "<u2", "<u4", "<i8", "<i8", "<u4")
#: A fragment's strings: two names and places, then the rows that hold them in turn.
_STRINGS = ("<u8", "<u2", "<u4", "<u4", "<i8", "<i8")


def _scan(fragments: int):
    """Rows of texts to packed runs by fragment, and what is settled in the batch."""
    def run(batches):
        for whole in batches:
            for start, end in slabs([n or 0 for n in pc.binary_length(whole.column(2)).to_pylist()], BATCH_BYTES):
                batch = whole.slice(start, end - start)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, qs, bs, docs, nos, parts = np.argsort(ids, kind="stable"), [], [], [], [], []
                marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = ((r, batch.column(2)[int(r)].as_py() or "") for r in rows)
                for tags, c in chunks(((r, k), raw) for r, t in texts for k, raw in pieces(t.encode("utf-8", "surrogatepass"))):
                    qs.append(c.anchor)
                    bs.append(refined(pointers(c.g, c.lo), pointers(c.g, c.hi)) + (c.rel * 64 + c.hi - c.lo).astype(np.uint64))
                    times = np.diff(c.first)
                    docs.append(np.repeat([r for r, _ in tags], times))
                    nos.append(np.arange(len(c.lo)) - np.repeat(c.first[:-1], times))
                    parts.append(np.repeat([k for _, k in tags], times))
                if not qs:
                    continue
                q, b, row, no, part = map(np.concatenate, (qs, bs, docs, nos, parts))
                goes, stays, rep, several = _settle(q, b, ids[row], np.zeros(len(q), bool))
                out = {"fragment": [], "packed": [], "doc": [], "mark": [], "piece": [], "goes": [], "open": []}

                def put(fragment, packed=None, doc=0, mark=0, piece=0, gone=None, opened=None):  # no nulls: pandas keeps integers
                    for name, v in zip(out, (fragment, packed, doc, mark, piece, gone, opened), strict=True):
                        out[name].append(v)

                frag = (q >> np.uint64(32)) % np.uint64(fragments)
                send = np.flatnonzero(rep)
                send = send[np.argsort(frag[send], kind="stable")]
                cuts = np.flatnonzero(np.diff(frag[send])) + 1
                for s in np.split(send, cuts):
                    if len(s):
                        number = (no[s] | np.where(several[s], _OPEN, 0)).astype("<u2")
                        at = _stretches(row[s], part[s])
                        times = np.diff(at, append=len(s)).astype("<u4")
                        own = row[s[at]]
                        put(int(frag[s[0]]), _pack(q[s].astype("<u4"), b[s].astype("<u8"), number, times, ids[own].astype("<i8"), marks[own].astype("<i8"), part[s[at]].astype("<u4")))
                for r, k, g, o in _by_piece(row, part, no, goes, stays):
                    put(int(ids[r]) % fragments, None, int(ids[r]), int(marks[r]), k, g, o)
                yield pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), pa.array(out["packed"], pa.binary()), pa.array(out["doc"], pa.int64()), pa.array(out["mark"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["goes"], pa.binary()), pa.array(out["open"], pa.binary())], names=list(out))

    return run


def _by_piece(row, part, no, goes, stays):
    """(row, piece, numbers of runs that go, of runs that stay open)."""
    at = np.flatnonzero(goes | stays)
    if not len(at):
        return
    at = at[np.lexsort((no[at], part[at], row[at]))]
    cuts = np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(part[at]) != 0)) + 1
    for s in np.split(at, cuts):
        yield int(row[s[0]]), int(part[s[0]]), no[s[goes[s]]].astype("<u2").tobytes(), no[s[stays[s]]].astype("<u2").tobytes()


def _refine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Rounds 1 and 2 over the representatives of one fragment."""
    passed = frame[frame["packed"].isna()][["doc", "mark", "piece", "goes", "open"]]
    cols: list[list] = [[], [], [], [], [], []]
    for raw in frame["packed"].dropna():
        q, b, number, times, *rows = _unpack(raw, *_RUNS)
        for held, c in zip(cols, (q, b, number, *(np.repeat(c, times) for c in rows)), strict=True):
            held.append(c)
    if not cols[0]:
        return passed
    q, b, number, doc, mark, part = map(np.concatenate, cols)
    goes, stays, _, _ = _settle(q, b, doc, (number & _OPEN) != 0)
    no = (number & (_OPEN - 1)).astype(np.int64)
    at = np.flatnonzero(goes | stays)
    doc, mark, part, no, goes, stays = (c[at] for c in (doc, mark, part.astype(np.int64), no, goes, stays))
    order = np.lexsort((mark, doc))
    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(mark[order]) != 0)]) if len(order) else np.empty(0, bool)
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    firsts = order[new]
    found = [(int(doc[firsts[r]]), int(mark[firsts[r]]), k, g, o) for r, k, g, o in _by_piece(row, part, no, goes, stays)]
    return pd.concat([passed, pd.DataFrame(found, columns=["doc", "mark", "piece", "goes", "open"])])


_FLAGS = "doc long, mark long, piece int, goes binary, open binary"


def _numbers(parts) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(p for p in parts if p), "<u2").astype(np.int64))


def _open_strings(fragments: int):
    """Strings of open runs, packed by fragment; those that go within a batch."""
    def wanted(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                flags = batch.column(3)[j].as_py()
                by_piece: dict[int, list] = {}
                for f in flags:
                    by_piece.setdefault(f["piece"], []).append(f)
                by_piece = {k: fs for k, fs in by_piece.items() if any(o for f in fs for o in f["open"])}
                if not by_piece:
                    continue
                doc, mark, text = (batch.column(i)[j].as_py() for i in range(3))
                for k, raw in pieces(text.encode("utf-8", "surrogatepass")):
                    if k in by_piece:
                        no = np.setdiff1d(_numbers([o for f in by_piece[k] for o in f["open"]]), _numbers([o for f in by_piece[k] for o in f["goes"]]))
                        if len(no):
                            yield (doc, mark, k, no), raw

    def run(batches):
        held = _Strings(fragments)
        for tags, c in chunks(wanted(batches)):
            no = np.concatenate([c.first[i] + tag[3] for i, tag in enumerate(tags)])
            n = c.hi[no] - c.lo[no] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c.lo[no], n)
            of = np.searchsorted(c.base, at, side="right") - 1
            place = at + (np.array([k for _, _, k, _ in tags]) * PIECE - c.base)[of]
            held.add([tag[:2] for tag in tags], of, pointers(c.g, at), pointers(c.g, at, _OTHER), place)
            if held.n >= HELD_STRINGS:
                yield held.batch()
                held = _Strings(fragments)
        if held.n:
            yield held.batch()

    return run


class _Strings:
    """Open strings of a batch: both names, place, and number of their row."""

    def __init__(self, fragments: int):
        self.fragments, self.n, self.rows, self.hs, self.js, self.ats, self.nos = fragments, 0, {}, [], [], [], []

    def add(self, rows: list, of, h, j, at):
        """Strings at places of rows (doc, mark); of: which row in the list."""
        self.n += len(at)
        self.hs.append(h)
        self.js.append(j >> np.uint64(48))
        self.ats.append(at)
        self.nos.append(np.array([self.rows.setdefault(r, len(self.rows)) for r in rows])[of])

    def batch(self) -> pa.RecordBatch:
        h, j, at, no = map(np.concatenate, (self.hs, self.js, self.ats, self.nos))
        docs, marks = (np.array(c, np.int64) for c in zip(*self.rows, strict=True))
        goes = _later(h, j, docs[no])
        send = np.flatnonzero(~goes)
        send = send[np.argsort(h[send] % np.uint64(self.fragments), kind="stable")]
        frag = (h[send] % np.uint64(self.fragments)).astype(np.int64)
        out = []
        for s in np.split(send, np.flatnonzero(np.diff(frag)) + 1):
            if len(s):
                first = _stretches(no[s])
                times, own = np.diff(first, append=len(s)).astype("<u4"), no[s[first]]
                out.append((int(h[s[0]] % np.uint64(self.fragments)), _pack(h[s].astype("<u8"), j[s].astype("<u2"), at[s].astype("<u4"), times, docs[own].astype("<i8"), marks[own].astype("<i8")), 0, 0, None))
        out.extend((int(docs[r]) % self.fragments, None, int(docs[r]), int(marks[r]), places) for r, places in _by_row(no, at, goes))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["fragment", "packed", "doc", "mark", "at"])


def _later(h: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a string also is in a smaller document of the batch."""
    order = np.lexsort((doc, j, h))
    first = _stretches(h[order], j[order])
    least = np.repeat(doc[order][first], np.diff(first, append=len(h)))
    out = np.empty(len(h), bool)
    out[order] = doc[order] != least
    return out


def _by_row(no, at, goes):
    """(row number, places as bytes) of the strings that go."""
    s = np.flatnonzero(goes)
    s = s[np.argsort(no[s], kind="stable")]
    for part in np.split(s, np.flatnonzero(np.diff(no[s])) + 1) if len(s) else ():
        yield int(no[part[0]]), at[part].astype("<u4").tobytes()


def _later_strings(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """(doc, mark, at): strings of a fragment that also are in a smaller document."""
    passed = frame[frame["packed"].isna()][["doc", "mark", "at"]]
    hs, js, ats, nos, docs, marks, base = [], [], [], [], [], [], 0
    for raw in frame["packed"].dropna():
        h, j, at, times, doc, mark = _unpack(raw, *_STRINGS)
        hs.append(h)
        js.append(j)
        ats.append(at)
        nos.append(np.repeat(np.arange(base, base + len(doc)), times))
        docs.append(doc)
        marks.append(mark)
        base += len(doc)
    if not hs:
        return passed
    h, j, at, no, doc, mark = map(np.concatenate, (hs, js, ats, nos, docs, marks))
    found = [(int(doc[r]), int(mark[r]), places) for r, places in _by_row(no, at, _later(h, j, doc[no]))]
    return pd.concat([passed, pd.DataFrame(found, columns=["doc", "mark", "at"])])


def _cut_texts(batches):
    """(doc, mark, n_removed, n_spans, kept_sha256) of texts with their flags."""
    for whole in batches:
        for start, end in slabs([n or 0 for n in pc.binary_length(whole.column(2)).to_pylist()], HELD_BYTES):
            doc, mark, texts, flags, singles = (whole.column(i).slice(start, end - start).to_pylist() for i in range(5))
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            edges = [np.zeros(len(raw) + 1, np.int32) for raw in raws]
            goes = [{f["piece"]: _numbers(f["goes"]) for f in fs} for fs in flags]
            held = (((r, k, goes[r][k]), part) for r, raw in enumerate(raws) for k, part in pieces(raw) if len(goes[r].get(k, ())))
            for tags, c in chunks(held):
                for i, (r, k, no) in enumerate(tags):
                    shift = k * PIECE - c.base[i]
                    edges[r][c.lo[c.of(i)][no] + shift] += 1
                    edges[r][c.hi[c.of(i)][no] + LENGTH + shift] -= 1
            out = []
            for r, (raw, edge, single) in enumerate(zip(raws, edges, singles, strict=True)):
                if single:
                    at = np.unique(np.frombuffer(b"".join(single), "<u4").astype(np.int64))
                    edge[at] += 1
                    edge[at + LENGTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc[r], mark[r], int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "mark", "n_removed", "n_spans", "kept_sha256"])


def _bucketed(df: DataFrame, what: str, keys: list[str]) -> DataFrame:
    """A table written once in buckets by its keys: joins on them don't move it again."""
    spark = df.sparkSession
    path, name = fresh_path(spark, what), f"{what}_{uuid.uuid4().hex}".replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts, *keys).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the files stay when the name goes
    spark.sql(f"drop table {name}")
    return out


def _marked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a mark that tells those of one id apart, and the bytes of texts that hold a string.

    The mark is written beside nearly every run and string and would be a third
    of what is shuffled, so it is 0 unless some id repeats, in texts of any length.
    """
    n = F.octet_length("text")
    by_id = rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows"), F.sum(F.when(n >= LENGTH, n)).alias("bytes"))
    size, most = by_id.agg(F.sum("bytes"), F.max("rows")).first()
    return rows.withColumn("mark", F.xxhash64("text") if (most or 0) > 1 else F.lit(0).cast("long")), size or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, size = _marked(rows)
    texts = rows.where(f"doc is not null and octet_length(text) >= {LENGTH}").select("doc", "mark", "text")
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    packed = texts.mapInArrow(_scan(fragments), f"fragment int, packed binary, {_FLAGS}")
    settled = packed.groupBy("fragment").applyInPandas(_refine, _FLAGS)
    flags = settled.groupBy("doc", "mark", "piece").agg(F.collect_list("goes").alias("goes"), F.collect_list("open").alias("open"))
    flags = flags.groupBy("doc", "mark").agg(F.collect_list(F.struct("piece", "goes", "open")).alias("flags"))
    with shuffles_removed(spark):
        flags = stored(flags, "repeat-flags")
        held = _bucketed(texts.join(flags, ["doc", "mark"]).select("doc", "mark", "text", "flags"), "repeat-texts", ["doc", "mark"])
        discard(flags)
        strings = held.mapInArrow(_open_strings(fragments), "fragment int, packed binary, doc long, mark long, at binary")
        later = strings.groupBy("fragment").applyInPandas(_later_strings, "doc long, mark long, at binary")
        single = stored(later.groupBy("doc", "mark").agg(F.collect_list("at").alias("single")), "repeat-strings")
    cut = held.join(single, ["doc", "mark"], "left").select("doc", "mark", "text", "flags", "single")
    cut = cut.mapInArrow(_cut_texts, "doc long, mark long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc", "mark"])
    every = rows.select("doc", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = every.join(cut, ["doc", "mark"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
