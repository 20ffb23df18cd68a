"""Token counts: numbers of tokens of whole texts, lengths only.

Arrow batches reach the Python workers and only three numbers for each row go
back. Within a batch, rows are taken in runs of about equal bytes; a text
beyond SEGMENT_CHARS is cut at safe boundaries and its parts are summed, so
memory holds one run and one part at a time; a part is longer than SEGMENT_CHARS
only by a run of letters or other characters in which no pre-token ends.

Null and empty texts count 0 bytes and 0 tokens. Rows with equal or null ids
each give a row. Further columns are ignored. Special strings inside a text
become their special token, as is the library's default.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.token_text import count_tokens, segments, slabs, tokenizer_path

SLAB_BYTES = 4 << 20
SEGMENT_CHARS = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; tokenizer: a byte-level BPE file."""
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def lengths(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
            counts: list[int] = []
            for a, b in slabs(sizes, SLAB_BYTES):
                run = texts.slice(a, b - a).to_pylist()
                if b - a == 1 and run[0] and len(run[0]) > SEGMENT_CHARS:
                    counts.append(sum(count_tokens([part], tokenizer)[0] for part in segments(run[0], SEGMENT_CHARS)))
                else:
                    counts.extend(count_tokens(run, tokenizer))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  (pa.compute is used in the tasks)

    schema = f"id {id_type.simpleString()}, n_bytes long, n_tokens long"
    out = rows.mapInArrow(lengths, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir) -> DataFrame:
    from rowlens.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
