"""A corpus pipeline: five operators in a row, each over all that the last one kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of documents. run() writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm import decontaminate, jaccard, mixing, token_files, toxicity
from rowlens.llm.common import fresh_name, fresh_path, table


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def _row_key() -> F.Column:
    """What tells rows apart even where ids repeat or are null."""
    return F.struct("doc_id", F.md5("text").alias("digest"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates.

    Five-word shingles, similarity 0.8. Rows without words link with nothing
    and stay; of rows that agree in id and text, one stays.
    """
    row = fresh_name(docs, "row")
    rows = docs.withColumn(row, _row_key())
    groups = jaccard.jaccard_components(rows, n=5, percent=80, id_col=row)
    spare = groups.where(F.col(row) != F.col("component_id")).select(row)
    return rows.dropDuplicates([row]).join(spare, row, "left_anti").select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents it doesn't take go.

    Rows that agree in id, source and text are one document, of which one row's
    further columns are kept; a null differs from an empty text or source.
    """
    row = fresh_name(docs, "row")
    times = fresh_name(docs, "times")
    parts = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    rows = docs.withColumn(row, F.concat_ws(":", *parts))
    taken = mixing.mix_sources(rows, id_col=row).where("taken > 0")
    taken = taken.groupBy(row).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias(times))
    out = rows.dropDuplicates([row]).join(taken, row)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def write_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files(docs, token_files.tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token files", write_tokens),
]

#: Compression and tokenizers can't be expressed in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
