"""The whole screening from all modules: what each one says arrives, and documents stay one row each."""

import pytest
from pyspark.sql import functions as F

from idsieve.queries import cases as qc, inputs as I, jobs as qj

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark):
    d = qj.screened(spark, SF).select(
        "doc_id", "ocr_status", "ocr_confidence", "field_completeness", "fields_status", "mrz_status", "name_cmp", "face_status", "ver_result", "similarity", "pad_decision", "severity",
        "overall_quality", "id_status", "decision", F.map_from_arrays(F.col("checks.item"), F.col("checks.status")).alias("checks"))
    return {r.doc_id: r for r in d.collect()}


def test_one_row_a_document(spark, out):
    ids = [r.doc_id for r in I.table(spark, SF, "documents").select("doc_id").collect()]
    assert sorted(out) == sorted(ids)


def test_modules_arrive_as_they_are(spark, out):
    for name, columns in (("text", ["ocr_status", "ocr_confidence", "field_completeness", "fields_status", "mrz_status", "name_cmp"]), ("tamper", ["severity"]),
                          ("faces", ["face_status", "ver_result", "similarity"]), ("liveness", ["pad_decision"]), ("quality", ["overall_quality"])):
        rows = {r.doc_id: r for r in qj.screen_modules(spark, SF)[name].select("doc_id", *columns).collect()}
        assert len(rows) > 10
        for k, r in out.items():
            assert [r[c] for c in columns] == ([rows[k][c] for c in columns] if k in rows else [None] * len(columns)), (name, k)


def test_checks_follow_the_modules(out):
    seen = {name: {r.checks.get(name) for r in out.values()} for name in ("ocr", "mrz", "face_photo", "liveness", "tampering_signals", "field_completeness")}
    assert {"PASS", "WARNING"} <= seen["ocr"] and {"PASS", "WARNING"} & seen["mrz"] and "PASS" in seen["face_photo"] and "WARNING" in seen["liveness"]
    for r in out.values():
        assert (r.checks["ocr"] == "PASS") == (r.ocr_status == "OK")
        if r.pad_decision and r.pad_decision.startswith("SUSPECT"):
            assert r.checks["liveness"] == "WARNING"
        if r.ver_result == "NO_MATCH":
            assert r.id_status == "NO_MATCH" and r.decision != "PASS"


def test_one_suspect_frame_counts(spark):
    from idsieve.plans import jobs

    frames = I.derive(spark, SF, qc.PAD).withColumn("channel_means", F.array("m1", "m2", "m3")).withColumn("k", F.col("event_id") % 20)
    worst = {r.doc_id: r.pad_decision for r in jobs.liveness_module(frames, "k").collect()}
    every = {}
    for r in jobs.liveness_job(frames).select("k", "pad_decision").collect():
        every.setdefault(r.k, set()).add(r.pad_decision)
    assert all((worst[k] == "SUSPECT_PRESENTATION_ATTACK") == ("SUSPECT_PRESENTATION_ATTACK" in v) for k, v in every.items())
