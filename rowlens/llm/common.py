"""Helpers shared by the training-text operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts, where the session sets no bound.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent on a single machine (local masters, as in
    tests), a fresh folder under the warehouse is set for the session. On a
    cluster that could be a folder that executors don't share, so it is an error.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got is None:
        got = sc.getCheckpointDir()
    if got is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
        got = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex[:12]}"
        sc.setCheckpointDir(got)
    return got


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; a bound that is set holds.

    The usual bound of rows alone lets a batch of texts be of any size, and a
    task holds it several times: as written and read in the JVM, and as received,
    cut and sent in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def file_system(path: str):
    """(file system, path in it) of a path or URI; a plain path is local."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of a table: written once as Parquet in the shared folder, read again."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, a write deletes its shuffle files as it ends.

    Else they stay until the driver's JVM happens to collect its garbage, and the
    disk holds those of several steps. For tables that cut the lineage: nothing
    reads what led to them again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """A table of about so many short rows, in no more partitions than it needs.

    Small tables meet in one task without a shuffle, larger ones leave few
    shuffle files; the number of partitions grows with the rows.
    """
    return df.coalesce(max(1, -(-rows // each)))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any spelling of its case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def word_count(text) -> F.Column:
    """Number of words in a text column (null: 0), without Python."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
