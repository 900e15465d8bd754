"""A table played again as a stream: small files in the order in which rows would have arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.plans.folders import work_folder
from idsieve.streaming.in_order import rocks


def replayed(rows: DataFrame, arrival: Column, parts: int, last: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Rows that ``make`` gives for the stream of ``rows`` cut into ``parts`` batches by ``arrival`` (0 to 1), then ``last``.

    Parts are written one after the other, and the file source reads older files first, so a row is never
    later than its part. ``last`` moves the watermark past all that waits. The stream runs in two goes
    from one checkpoint. All folders are under the shared one; the result is the table the stream has written.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, name)
    part = F.least(F.floor(arrival * parts), F.lit(parts - 1))
    dealt = rows.withColumn("_part", part)

    def go() -> None:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
        with rocks(spark):
            (make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    for k in range(parts):
        dealt.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/in")
        if k in (parts // 2, parts - 1):
            go()
    last.select(rows.columns).write.mode("append").parquet(f"{folder}/in")
    go()
    return spark.read.parquet(f"{folder}/out")
