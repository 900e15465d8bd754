"""Shared folders and checkpoints: intermediate results that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        known = tempfile.mkdtemp(prefix="idsieve-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, with its lineage cut."""
    base_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder."""
    path = f"{base_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._idsieve_folder = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once their successors are written; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._idsieve_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


MARKS = 4_000_000  # hashes of repeated rows that are sent to every task, at most


def by_copies(rows: DataFrame, *columns: str) -> tuple[DataFrame | None, DataFrame]:
    """``rows`` in two parts: those whose ``columns`` no other row has, and all others.

    Rows of the first part need no exchange to find their copies. They are told by hashes, of which only repeated ones are
    kept; a row whose hash is another's by chance is in the second part, which may hold rows without a copy. With more
    repeated hashes than MARKS all rows are in the second part, and there is no first.
    """
    mark = F.xxhash64(*columns)
    repeated = written(rows.select(mark.alias("_mark")).groupBy("_mark").count().filter("count > 1").select("_mark"), "repeated")
    if repeated.count() > MARKS:
        return None, rows
    marked, known = rows.withColumn("_mark", mark), F.broadcast(repeated)
    return marked.join(known, "_mark", "left_anti").select(*rows.columns), marked.join(known, "_mark", "left_semi").select(*rows.columns)
