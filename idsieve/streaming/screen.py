"""Continuous intake to screened cases, their audit rows and the tips of their chains.

A micro-batch writes to several sinks. Each sink gets a folder of its own per batch, in overwrite mode, and the batch
counts only once its number is in the list of finished batches, which is written last. Readers go
through that list, so they see all sinks of a batch or none. A batch that is repeated after a lost executor or driver
replaces what it had written, or does nothing if it had finished. What a batch takes from earlier ones (case numbers, tips) it reads from finished batches
before it, so a repeated batch takes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from idsieve.operators import audit, cases
from idsieve.operators.ordered import last_per_key

FINISHED = "finished"


def screen_stream(source: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Screen each micro-batch with the batch transforms and write its cases.

    A batch writes to its own directory in overwrite mode, so a repeated batch
    after a lost executor or driver replaces itself and adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        screen(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def finished(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the finished batches; one row a batch."""
    try:
        rows = spark.read.schema("batch long").parquet(f"{path}/{FINISHED}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted({r["batch"] for r in rows.select("batch").distinct().collect() if before is None or r["batch"] < before})


def read_sink(spark: SparkSession, path: str, sink: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of a sink, with their ``batch``, of finished batches; no rows where there is none."""
    done = finished(spark, path, before)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    known = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{sink}")
    return known.parquet(*[f"{path}/{sink}/batch={k}" for k in done])


def write_batch(spark: SparkSession, path: str, batch_id: int, sinks: dict[str, DataFrame]) -> None:
    """All sinks of one batch, then its number."""
    for name, rows in sinks.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    spark.createDataFrame([(1,)], "done int").coalesce(1).write.mode("overwrite").parquet(f"{path}/{FINISHED}/batch={batch_id}")


CASES = "doc_id long, case_id string, submitted_at timestamp, year int, seq long, decision string, document_type string, confidence double"
EVENTS = "id long, case_id string, action string, actor string, summary string, prev_hash string, entry_hash string"
TIPS = "case_id string, tip string"


def screen_batch(batch: DataFrame, batch_id: int, path: str, screen: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The sinks of one batch. batch: doc_id, submitted_at, and what ``screen`` reads; it gives doc_id, decision, document_type, confidence.

    A document that was seen before keeps its case, which gets another event; new ones are numbered on, by year.
    """
    spark = batch.sparkSession
    known = read_sink(spark, path, "cases", CASES, batch_id)
    held = last_per_key(known.select("doc_id", "case_id", "year", "seq", "batch"), ["doc_id"], F.col("batch")).drop("batch")
    rows = screen(batch).join(batch.select("doc_id", "submitted_at"), "doc_id")
    seen = rows.join(held, "doc_id")
    fresh = rows.join(held.select("doc_id"), "doc_id", "left_anti")
    taken = held.groupBy("year").agg(F.max("seq").alias("taken"))
    numbered = cases.allocate_ids(fresh, taken)
    both = numbered.unionByName(seen).select([F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in CASES.split(", ")])
    both.write.mode("overwrite").parquet(f"{path}/cases/batch={batch_id}")
    written = spark.read.schema(CASES).parquet(f"{path}/cases/batch={batch_id}")
    said = F.concat(F.lit("decision="), F.coalesce("decision", F.lit("None")), F.lit(" type="), F.coalesce("document_type", F.lit("None")))
    events = written.select((F.lit(batch_id).cast("long") * (1 << 40) + F.col("seq")).alias("id"), "case_id", F.lit("ANALYZE").alias("action"),
                            F.lit("system").alias("actor"), said.alias("summary"))
    tips = last_per_key(read_sink(spark, path, "tips", TIPS, batch_id), ["case_id"], F.col("batch")).select("case_id", "tip")
    audit.append(events, tips).write.mode("overwrite").parquet(f"{path}/audit/batch={batch_id}")
    chained = spark.read.schema(EVENTS).parquet(f"{path}/audit/batch={batch_id}")
    return {"tips": chained.groupBy("case_id").agg(F.max_by("entry_hash", "id").alias("tip"))}


def take_batch(batch: DataFrame, batch_id: int, path: str, screen: Callable[[DataFrame], DataFrame]) -> None:
    if batch_id not in finished(batch.sparkSession, path):
        write_batch(batch.sparkSession, path, batch_id, screen_batch(batch, batch_id, path, screen))


def screen_to_sinks(source: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Screen a stream into the sinks cases, audit and tips under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, path, screen)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
