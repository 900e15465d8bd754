"""Work on derived rows is spread over tasks, and done once."""

import pytest
from pyspark.sql import functions as F

from idsieve.operators import fields as of, mrz as om
from idsieve.queries import cases as qc, inputs as I


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of one row group each, with a repeated key."""
    folder = str(tmp_path_factory.mktemp("one"))
    customers = spark.range(400).select((F.col("id") % 390).alias("c_custkey")).coalesce(1)
    customers.write.parquet(f"{folder}/customer.parquet")
    spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def _sizes(df):
    return [n for n in df.groupBy(F.spark_partition_id()).count().toPandas()["count"]]


@pytest.mark.parametrize("make", [I.id_text, I.mrz_text, qc.events])
def test_one_row_group_is_many_tasks(spark, sf, make):
    d = make(spark, sf)
    sizes = _sizes(d)
    assert sum(sizes) == (200 if make is qc.events else 400)
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2


def _below_exchange(df):
    """The physical plan under the exchange that deals the rows out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("RoundRobinPartitioning"):]


def test_filters_on_verdicts_do_not_run_in_the_scan(spark, sf):
    parsed = om.parse(I.mrz_text(spark, sf)).filter("parsed IS NOT NULL").select("doc_id", "parsed.dob")
    items = om.analyze(I.mrz_text(spark, sf)).select("doc_id", F.inline("checklist"))
    found = of.extract(I.id_text(spark, sf), I.at(spark, I.TODAY))
    for d in (parsed, items, found):
        assert "Filter (" not in _below_exchange(d) and "- Filter" not in _below_exchange(d)


def test_modules_and_fields_are_merged_not_broadcast(spark):
    from idsieve.operators import evidence as oe
    from idsieve.plans import jobs

    docs = spark.createDataFrame([(i % 9, "PAN") for i in range(10)], "doc_id long, document_type string")
    boxes = spark.createDataFrame(
        [(i, "gray", 0, 0, 0, i, 1, 2, 3, 4, f"w{i}", 0.5) for i in range(9)],
        "doc_id long, pass string, pass_ord int, block_num int, line_num int, box_ord int, x int, y int, w int, h int, text string, confidence double")
    text = jobs.text_module(docs, boxes, I.at(spark, I.TODAY))
    plan = oe.join_evidence(docs.select("doc_id"), [text])._jdf.queryExecution().executedPlan().toString()
    # Types and their fixed profiles are the one broadcast.
    by_key = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "_type" not in x]
    assert not by_key, by_key
