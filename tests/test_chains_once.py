"""Chains are folded once by queries that read them several times."""

from idsieve.operators import audit as oa
from idsieve.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_are_folded_once(spark, tmp_path):
    rows = [(k, k % 13, "click", float(k)) for k in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("audit_anchor_check", "audit_broken_at", "case_detail"):
        df = QUERIES[name](spark, str(tmp_path))
        assert "MapInPandas" not in _plan(df), name
        assert df.count() == 13
    assert {r.case_id: r.broken_at for r in QUERIES["audit_broken_at"](spark, str(tmp_path)).collect()}["case-7"] == 0
    linked = oa.links(oa.append(spark.range(9).selectExpr("id", "'c' AS case_id", "'a' AS action", "'b' AS actor", "'s' AS summary")))
    assert "MapInPandas" not in _plan(oa.broken_at(linked))
