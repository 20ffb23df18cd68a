"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A file set is a folder of shards in ascending id order. Shard k holds

* ``tokens-k.bin``   token ids, little-endian, 16 bits if the end id and every
  id of the vocabulary fit, else 32 (or as asked for);
* ``offsets-k.bin``  unsigned 64-bit: for each document the number of ids in
  the whole set before it, then the end of its last document;
* ``ids-k.bin``      signed 64-bit document ids (null: the smallest value).

Texts are range-partitioned by id and a digest of the text, so a shard is written by one task, which
encodes and appends run by run. Its token count is all that the driver sees;
prefix sums over the shards give each one's base, and a second small job
writes the offsets. Every file is written under a name of its attempt and then
renamed, so a repeated task replaces a lost one's files. Where the folder is
local or mounted, readers map the files into memory.

Null and empty texts hold the end id alone; equal and null ids stay apart,
ordered by that digest and then by text, and may fill many shards; an empty table gives a set without shards. Further columns are
ignored.
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import file_system, fresh_path, table
from rowlens.llm.token_text import encode_ids, load, segments, slabs, tokenizer_path

SLAB_BYTES = 4 << 20
SEGMENT_CHARS = 1 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 64 << 20
NULL_ID = -(1 << 63)


def _name(what: str, shard: int) -> str:
    return f"{what}-{shard:06d}.bin"


def _put(fs, path: str, attempt: str, chunks) -> int:
    """Write chunks under the attempt's name, then rename; bytes written."""
    n = 0
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(f"{path}.{attempt}", path)
    return n


def _read(fs, path: str) -> memoryview:
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        with open(path, "rb") as f:
            if f.seek(0, 2) == 0:
                return memoryview(b"")
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_file(path) as f:
        return memoryview(f.read())


def needs_wide(tokenizer: str, end_id: int) -> bool:
    """Whether the vocabulary or the end id needs more than 16 bits."""
    return max(end_id, *load(tokenizer).get_vocab(with_added_tokens=True).values()) > 0xFFFF


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", wide: bool | None = None) -> list[tuple[int, int, int]]:
    """Write the set into a new folder; (shard, documents, base) in order."""
    dtype = "<u4" if (needs_wide(tokenizer, end_id) if wide is None else wide) else "<u2"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def write(batches):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), f"{task.taskAttemptId()}"
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        end, ids, lengths = np.array([end_id], dtype).tobytes(), [], []

        def encoded():
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                ids.append(keys.fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
                for a, b in slabs(sizes, SLAB_BYTES):
                    run = texts.slice(a, b - a).to_pylist()
                    if b - a == 1 and run[0] and len(run[0]) > SEGMENT_CHARS:
                        n = 0
                        for part in segments(run[0], SEGMENT_CHARS):
                            got = encode_ids([part], tokenizer, dtype)[0]
                            n += len(got)
                            yield got
                        yield end
                        lengths.append(n + len(end))
                        continue
                    out = encode_ids(run, tokenizer, dtype)
                    lengths.extend(len(x) + len(end) for x in out)
                    yield end.join(out) + end

        stream = encoded()
        first = next(stream, None)
        if first is None:
            return
        _put(fs, f"{at}/{_name('tokens', shard)}", attempt, _chain(first, stream))
        n = np.array(lengths, "<u8") // np.dtype(dtype).itemsize
        _put(fs, f"{at}/{_name('lengths', shard)}", attempt, [n.tobytes()])
        _put(fs, f"{at}/{_name('ids', shard)}", attempt, [np.concatenate(ids).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(n), int(n.sum()))], names=["shard", "docs", "tokens"])

    ranged = rows.repartitionByRange(shards, "id", "digest").sortWithinPartitions("id", "digest", "text").select("id", "text")
    counts = sorted(tuple(r) for r in ranged.mapInArrow(write, "shard long, docs long, tokens long").collect())
    bases, base = [], 0
    for shard, n, tokens in counts:
        bases.append((shard, n, base))
        base += tokens

    def offsets(frames):
        fs, at = file_system(folder)
        for frame in frames:
            for shard, base in zip(frame["shard"], frame["base"], strict=True):
                n = np.frombuffer(_read(fs, f"{at}/{_name('lengths', shard)}"), "<u8")
                starts = np.concatenate([[0], np.cumsum(n)]).astype("<u8") + np.uint64(base)
                _put(fs, f"{at}/{_name('offsets', shard)}", f"{TaskContext.get().taskAttemptId()}", [starts.tobytes()])
            yield frame[["shard"]]

    if bases:
        _shard_table(spark, bases).mapInPandas(offsets, "shard long").count()
    return bases


def _chain(first, rest):
    yield first
    yield from rest


def _shard_table(spark, bases) -> DataFrame:
    return spark.createDataFrame(bases, "shard long, docs long, base long").repartition(len(bases), "shard")


def read_token_files(spark, folder: str, bases, wide: bool = False, batch_docs: int = 5000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    dtype = "<u4" if wide else "<u2"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)

    def read(frames):
        fs, at = file_system(folder)
        for frame in frames:
            for shard, base in zip(frame["shard"], frame["base"], strict=True):
                tokens = np.frombuffer(_read(fs, f"{at}/{_name('tokens', shard)}"), dtype)
                ends = np.frombuffer(_read(fs, f"{at}/{_name('offsets', shard)}"), "<u8").astype(np.int64)
                ids = np.frombuffer(_read(fs, f"{at}/{_name('ids', shard)}"), "<i8")
                for a in range(0, len(ids), batch_docs):
                    b = min(a + batch_docs, len(ids))
                    sums = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(ends[a:b] - base, ends[a + 1 : b + 1] - base, strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64").copy(), "start": ends[a:b], "n_tokens": np.diff(ends[a : b + 1]), "ids_crc32": sums}).assign(doc_id=lambda x: x["doc_id"].mask(x["doc_id"] == NULL_ID))

    return _shard_table(spark, bases).mapInPandas(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **cols) -> DataFrame:
    """Write the file set (a fresh shared folder by default) and read it back."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    wide = needs_wide(tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id, wide=wide, **cols), wide)


def op4_token_files(spark, sf_dir) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
