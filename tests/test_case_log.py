"""Both versions of a case come from one numbering."""

from pyspark.sql import functions as F

from idsieve.queries import cases as qc


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cases_are_numbered_once(spark, tmp_path):
    rows = [(k, k, "O", 1.0, f"2024-01-{1 + k % 28:02d} 00:00:00", "1-URGENT") for k in range(1, 41)]
    d = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string")
    d.withColumn("o_orderdate", F.to_timestamp("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    log = qc.log(spark, str(tmp_path))
    assert _plan(log).count("Window") == _plan(qc.ided(spark, str(tmp_path))).count("Window")
    got = {(r["doc_id"], r["decision"]): r for r in log.collect()}
    assert len(got) == 40 + sum(k % 3 != 0 for k in range(1, 41))
    assert got[3, "PENDING"]["evidence_json"] == "{}" and got[4, "PASS"]["document_type"] == "VISA" and got[4, "PASS"]["authenticity_estimate"] is None
    assert got[5, "PENDING"]["confidence"] is None and got[5, "HIGH-RISK"]["confidence"] == 5 / 97.0 and got[7, "HIGH-RISK"]["evidence_json"] == "not json"
