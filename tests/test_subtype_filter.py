"""A filter on the document type does not rank every document anew."""

from pyspark.sql import functions as F

from idsieve.operators import classify as oc
from idsieve.queries import vectors as qv


def _documents(spark):
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("national id "), F.col("id"), F.lit(".png")).alias("filename"),
                               (F.lit(300) + F.col("id") * 17).alias("width"), F.lit(400).alias("height"))
    share = (F.col("doc_id") * 7 % 11) / 11.0
    return d.withColumns({c: share for c in ("blue_frac", "warm_frac", "cyan_frac", "green_frac", "mean_saturation", "mean_value",
                                             "top_edge", "mid_edge", "bottom_edge", "photo_left_bias")})


def test_ranked_once_below_a_filter(spark):
    found = oc.subtype(oc.gate(oc.heuristic(oc.feature_vector(oc.features(oc.filename_priors(_documents(spark))))).transform(
        lambda d: oc.blend(d, qv.CW, qv.CB))))
    kept = found.filter("core_type = 'NATIONAL_ID'").select("doc_id", "core_type", "document_type")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1
    all_rows = [tuple(x) for x in found.select("doc_id", "core_type", "document_type").collect()]
    assert sorted(tuple(x) for x in kept.collect()) == sorted(x for x in all_rows if x[1] == "NATIONAL_ID")
