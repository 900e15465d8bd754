"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from idsieve.operators import rasters
from idsieve.plans.session import local_session
from idsieve.queries import QUERIES

HEADLINE = (
    "screen_all", "decide", "cv_rules", "agg_check_rollup", "fx_fields", "join_field_box_conf",
    "agg_field_completeness", "mrz_analyze", "job_quality", "job_tamper", "job_text_visual",
    "win_percentile_norm", "agg_color_fracs", "job_classify", "job_features", "fusion_score",
    "face_compare", "job_liveness", "st_rate_limit", "case_id_alloc", "report_markdown",
    "audit_append", "agg_chain_status", "job_intake", "sort_reading_order",
)


def large_images(spark, side=2_000, count=8):
    """Tamper signals of images of 2,000 by 2,000 pixels; their planes are made before the clock starts."""
    gray = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.pmod(F.xxhash64(i, F.col("id")), F.lit(256)).cast("float"))
    made = spark.range(count).repartition(count).select(F.col("id").alias("doc_id"), F.lit(side).alias("img_h"), F.lit(side).alias("img_w"), gray.alias("gray"))
    made = made.withColumns({p: F.transform("gray", lambda x, k=k: x * k % 97) for k, p in ((3, "ela"), (5, "hf"), (7, "noise"))})
    made.cache().count()
    return rasters.tamper_signals(made)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    large = large_images(spark)
    t = time.perf_counter()
    large.write.format("noop").mode("overwrite").save()
    times["images_2000"] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
