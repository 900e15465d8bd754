"""Every registered query runs at the smallest scale; those with SQL agree with it."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 180


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# One query per family here; tools/check_oracle.py compares all of them.
@pytest.mark.parametrize("name", [
    "fx_fields", "mrz_analyze", "job_quality", "agg_check_rollup", "decide", "face_compare", "case_summary",
    "audit_append", "job_intake", "job_features", "top_hotspots", "win_robust_outlier", "st_rate_limit",
])
def test_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
