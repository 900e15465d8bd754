"""Decision and identity tables, checks and calibration."""

import math

import pytest
from pyspark.sql import functions as F

from idsieve.operators import decision as od, evidence as oe, identity as oi, models as om

DOC = ("doc_id long, prior_decision string, evidence_quality double, authenticity_estimate double, confidence double, "
       "severity string, cv_overall string, n_fail long, fusion_status string, fusion_authentic double, fusion_tampered double, "
       "face_status string, camera_status string, live_face_status string, live_face_count long, ver_status string, "
       "ver_result string, similarity double, embedding_sources string")
GOOD = dict(doc_id=1, prior_decision="PENDING", evidence_quality=0.8, authenticity_estimate=0.88, confidence=0.7,
            severity="LOW_SIGNAL", cv_overall="PASS", n_fail=0, fusion_status="FUSED", fusion_authentic=0.8,
            fusion_tampered=0.2, face_status="DETECTED", camera_status="CAPTURED", live_face_status="DETECTED",
            live_face_count=1, ver_status="COMPARED_UNCALIBRATED", ver_result="MATCH", similarity=0.92,
            embedding_sources="DIFFERENT")


@pytest.mark.parametrize("change,decision,doc,ident", [
    ({}, "PASS", "AUTHENTIC", "MATCH"),
    (dict(authenticity_estimate=0.1, fusion_tampered=0.9), "HIGH-RISK", "SUSPICIOUS", "MATCH"),
    (dict(face_status="NOT_DETECTED", camera_status=None, ver_status=None, ver_result=None, similarity=None,
          live_face_status=None, live_face_count=None), "INCONCLUSIVE", "AUTHENTIC", "FACE_NOT_DETECTED"),
    (dict(ver_result="NO_MATCH"), "INCONCLUSIVE", "AUTHENTIC", "NO_MATCH"),
    (dict(severity="ELEVATED_REVIEW"), "HIGH-RISK", "TAMPERING_INDICATED", "MATCH"),
    (dict(ver_result=None, ver_status=None, similarity=None), "INCONCLUSIVE", "AUTHENTIC", "NOT_ASSESSED"),
    (dict(ver_result=None, similarity=0.918), "INCONCLUSIVE", "AUTHENTIC", "INCONCLUSIVE"),
    (dict(embedding_sources="SAME_IMAGE_BYTES"), "INCONCLUSIVE", "AUTHENTIC", "INCONCLUSIVE"),
    (dict(live_face_count=2), "INCONCLUSIVE", "AUTHENTIC", "INCONCLUSIVE"),
    (dict(similarity=None), "INCONCLUSIVE", "AUTHENTIC", "INCONCLUSIVE"),
    (dict(camera_status=None, ver_status=None, ver_result=None, live_face_status=None, live_face_count=None),
     "INCONCLUSIVE", "AUTHENTIC", "AWAITING_LIVE"),
])
def test_decide(spark, change, decision, doc, ident):
    row = {**GOOD, **change}
    d = spark.createDataFrame([tuple(row[c.split()[0]] for c in DOC.split(", "))], DOC)
    r = od.decide(d).first()
    assert (r.decision, r.doc_status, r.id_status) == (decision, doc, ident)


def test_filter_on_decision_stays_cheap(spark):
    d = spark.createDataFrame([tuple(GOOD[c.split()[0]] for c in DOC.split(", "))], DOC)
    assert od.decide(d).filter("decision = 'PASS' AND doc_status = 'AUTHENTIC'").count() == 1


def test_checks(spark):
    d = spark.createDataFrame([(1, True, 0.2, 0.7, 0.2, "ALIGNED")],
                              "doc_id long, insufficient_for_analysis boolean, overall_quality double, enet_auth double, vit_auth double, clip_agreement string")
    c = {r["item"]: r.status for r in oe.checks(d).collect()}
    assert (c["image_quality"], c["head_agreement"], c["clip_type_alignment"]) == ("FAIL", "WARNING", "PASS")
    long = oe.rollup(oe.checks(d)).first()
    row = oe.rollup_in_row(oe.checks_column(d)).first()
    assert long.cv_overall == row.cv_overall == "FAIL" and long.cv_pass_rate == row.cv_pass_rate


def test_calibration_is_increasing(spark):
    d = spark.range(1, 100).select((F.col("id") / 100).alias("fusion_authentic"), F.lit("FUSED").alias("fusion_status"),
                                   F.lit("PENDING").alias("prior_decision"), F.lit(True).alias("quality_ok"))
    est = [r.authenticity_estimate for r in om.calibrate(d, 1.4, -0.2).orderBy("fusion_authentic").collect()]
    assert est == sorted(est) and est[0] < 0.05 and est[-1] > 0.95
    skipped = om.calibrate(d.withColumn("quality_ok", F.lit(False)), 1.4, -0.2).first()
    assert skipped.calibration_status == "SKIPPED" and skipped.authenticity_estimate is None


def test_fit_platt_has_a_positive_slope(spark):
    d = spark.range(400).select(((F.col("id") % 99 + 1) / 100).alias("p")).withColumn("y", F.col("p") + F.rand(3) * 0.4 > 0.7)
    assert om.fit_platt(d, "p", "y")[0] > 0


def test_fusion_needs_vision(spark):
    from idsieve.functions.fixed import FUSION_DIM, FUSION_LAYOUT
    cols = [F.lit(None).cast("array<double>" if n > 1 else "double").alias(c) for c, n in FUSION_LAYOUT]
    d = spark.range(1).select(*cols)
    w, b = [[0.1] * FUSION_DIM, [-0.1] * FUSION_DIM], [0.0, 0.0]
    assert om.fuse(d, w, b).first().fusion_status == "NOT_ASSESSED"
    r = om.fuse(d.withColumn("clip_present", F.lit(1.0)), w, b).first()
    assert r.fusion_status == "FUSED" and math.isclose(r.fusion_authentic + r.fusion_tampered, 1.0, abs_tol=2e-4)


def face(vec, sha, label="GOOD"):
    return (vec, label, sha)


@pytest.mark.parametrize("a,b,result,source", [
    (([1.0, 0.0, 0.2], "a"), ([1.0, 0.0, 0.21], "b"), "MATCH", "DIFFERENT"),
    (([1.0, 0.0, 0.2], "a"), ([1.0, 0.0, 0.21], "a"), "INCONCLUSIVE", "SAME_IMAGE_BYTES"),
    (([1.0, 0.0, 0.2], "a"), ([1.0, 0.0, 0.2], "b"), "INCONCLUSIVE", "IDENTICAL_VECTOR"),
    (([1.0, 0.0, 0.0], "a"), ([0.0, 1.0, 0.0], "b"), "NO_MATCH", "DIFFERENT"),
])
def test_compare_faces(spark, a, b, result, source):
    kind = "struct<embedding:array<double>,face_label:string,image_sha:string>"
    d = spark.createDataFrame([(face(*a), 1, face(*b), 1)], f"doc {kind}, doc_count long, live {kind}, live_count long")
    r = oi.compare_faces(d).first()
    assert (r.cmp_result, r.embedding_sources) == (result, source)
