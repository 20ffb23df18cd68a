"""What queries share: their register, tables, and files written for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.sources.detect import open_path

QUERIES: dict = {}
ORACLES: dict = {}
#: Files that a table is written to.
PARTS = 4


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; files need a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/records-{uuid.uuid4().hex}"


def write_files(lines: DataFrame, parts: int = PARTS) -> str:
    """Files of the lines (value), in the order of no over their names; returns their folder."""
    folder = scratch(lines.sparkSession)
    lines.repartitionByRange(parts, "no").sortWithinPartitions("no").select("value").write.option("lineSep", "\n").text(folder)
    return folder


def write_documents(lines: DataFrame, ending: str) -> list[str]:
    """A file of the lines (value, ordered by no) for each doc; returns the paths by doc."""
    folder = scratch(lines.sparkSession)
    lines.repartition("doc").sortWithinPartitions("doc", "no").select("doc", "value").write.partitionBy("doc").option("lineSep", "\n").text(folder)
    fs, at = open_path(folder)
    from pyarrow.fs import FileSelector

    found = []
    for info in fs.get_file_info(FileSelector(at, recursive=True)):
        if "/part-" in info.path and info.size:
            doc = info.path.rsplit("/", 2)[1].removeprefix("doc=")
            fs.move(info.path, f"{at}/{doc}{ending}")
            found.append(doc)
    return [f"{folder}/{doc}{ending}" for doc in sorted(found)]


def bracketed(rows: DataFrame, head: str = "", tail: str = "") -> DataFrame:
    """Lines (no, value) with a first and a last one."""
    for no, line in ((-1, head), (1 << 40, tail)):
        if line:
            rows = rows.unionByName(rows.sparkSession.range(1).select(F.lit(no).cast("long").alias("no"), F.lit(line).alias("value")))
    return rows
