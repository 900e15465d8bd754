"""Checks, confidence, decisions and whole screening over documents and labels."""

from pyspark.sql import functions as F

from idsieve.operators import decision as od, evidence as oe
from idsieve.queries import inputs as I
from idsieve.queries.inputs import _pick
from idsieve.queries.registry import query

# Stand-in module outputs of every document.
EV = f"""SELECT d.doc_id, CAST(round(least(1.0, CAST(n_chars AS DOUBLE) / 2000.0), 4) AS DOUBLE) AS evidence_quality, CAST(round(least(1.0, CAST(n_chars AS DOUBLE) / 2000.0), 4) AS DOUBLE) AS overall_quality, d.doc_id % 13 = 0 AS insufficient_for_analysis,
 {_pick('PASSPORT,VISA,NATIONAL_ID,OTHER,UNKNOWN', 'd.doc_id')} AS document_type, CAST(d.doc_id * 7 % 101 AS DOUBLE) / 101.0 AS type_confidence,
 CASE d.doc_id % 6 WHEN 3 THEN 'SKIPPED' WHEN 4 THEN 'ERROR' WHEN 5 THEN NULL ELSE 'OK' END AS ocr_status, CASE WHEN d.doc_id % 8 = 0 THEN NULL ELSE CAST(d.doc_id * 3 % 97 AS DOUBLE) / 97.0 END AS ocr_confidence,
 CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE CAST(d.doc_id * 11 % 103 AS DOUBLE) / 103.0 END AS field_completeness, CASE WHEN d.doc_id % 4 = 0 THEN 'NO_FIELDS' ELSE 'PARTIAL' END AS fields_status, CAST(d.doc_id % 4 AS BIGINT) AS field_count,
 CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(d.doc_id * 13 % 89 AS DOUBLE) / 89.0 END AS mean_field_ocr_confidence, d.doc_id % 3 <> 2 AS supports_mrz,
 CASE d.doc_id % 5 WHEN 0 THEN 'NOT_DETECTED' WHEN 1 THEN 'PARTIAL' WHEN 4 THEN NULL ELSE 'PARSED' END AS mrz_status, CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'FAIL' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'NOT_ASSESSED' ELSE 'PASS' END AS name_cmp,
 CASE WHEN d.doc_id % 17 = 0 THEN 'FAIL' ELSE 'PASS' END AS dob_cmp, 'PASS' AS number_cmp, d.doc_id % 2 = 0 AS expects_photo,
 CASE d.doc_id % 4 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'NOT_DETECTED' WHEN 2 THEN 'MULTIPLE_DETECTED' END AS face_status, CASE d.doc_id % 3 WHEN 0 THEN 'NOT_APPLICABLE' WHEN 1 THEN 'PASSIVE_ASSESSED' ELSE 'NOT_ASSESSED' END AS pad_status,
 CASE d.doc_id % 7 WHEN 0 THEN 'SUSPECT_PRESENTATION_ATTACK' WHEN 1 THEN 'INCONCLUSIVE' ELSE 'PASSIVE_OK_UNCALIBRATED' END AS pad_decision, CASE d.doc_id % 4 WHEN 0 THEN 'ALIGNED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'DIVERGENT' END AS clip_agreement,
 CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST(d.doc_id * 17 % 107 AS DOUBLE) / 107.0 END AS enet_auth, CAST(d.doc_id * 19 % 109 AS DOUBLE) / 109.0 AS vit_auth, d.doc_id % 10 <> 0 AS enet_ok, d.doc_id % 2 = 0 AS vit_ok, d.doc_id % 3 = 0 AS clip_ok,
 CASE WHEN d.doc_id % 12 = 0 THEN 'ERROR' ELSE 'ANALYZED' END AS tamper_status, CASE toxic WHEN 1 THEN 'ELEVATED_REVIEW' WHEN 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 'MILD_REVIEW' ELSE 'LOW_SIGNAL' END ELSE 'NOT_ASSESSED' END AS severity,
 CASE WHEN d.doc_id % 7 = 3 THEN 'NOT_ASSESSED' ELSE 'FUSED' END AS fusion_status, CASE WHEN d.doc_id % 7 = 3 THEN NULL ELSE CAST(d.doc_id * 23 % 113 AS DOUBLE) / 113.0 END AS fusion_authentic, CASE WHEN d.doc_id % 7 = 3 THEN NULL ELSE CAST(1 AS DOUBLE) - CAST(d.doc_id * 23 % 113 AS DOUBLE) / 113.0 END AS fusion_tampered,
 CASE d.doc_id % 4 WHEN 0 THEN 'AGREE' ELSE 'PARTIAL' END AS head_agreement, CASE d.doc_id % 3 WHEN 0 THEN 'CALIBRATED' WHEN 1 THEN 'SKIPPED' ELSE 'NOT_ASSESSED' END AS calibration_status,
 CAST(CASE quality WHEN 1 THEN 0.7 WHEN 0 THEN 0.2 END AS DOUBLE) AS authenticity_estimate, CAST(CASE WHEN d.doc_id % 19 = 0 THEN 2 ELSE 0 END AS INT) AS typography_anomalies, quality, toxic
FROM {{documents}} d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id"""
EV_SQL = I.plain(EV)


def ev(spark, sf):
    d = I.derive(spark, sf, EV)
    kind = "array<struct<check:string,status:string>>"
    dates = F.when(F.col("doc_id") % 23 == 0, F.array(F.struct(F.lit("issue_after_dob").alias("check"), F.lit("FAIL").alias("status")))).otherwise(
        F.array(F.struct(F.lit("date_ordering").alias("check"), F.lit("PASS").alias("status")))).cast(kind)
    visual = F.when(F.col("doc_id") % 6 == 0, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(
        F.concat(F.lit("f"), i.cast("string")).alias("field"), F.when(i == 2, F.lit("INCONSISTENT")).when(i == 3, F.lit("NOT_FOUND")).otherwise(F.lit("CONSISTENT")).alias("status"))))
    return d.withColumns({"date_checks": dates, "ocr_visual": visual})


def row(item, st, sev=None, cond="true"):
    sev = sev or f"CASE WHEN ({st}) = 'FAIL' THEN 'elevated' WHEN ({st}) = 'WARNING' THEN 'review' ELSE 'info' END"
    return f"CASE WHEN {cond} THEN {{'item': '{item}', 'status': {st}, 'severity': {sev}}} END"


_HASM = "(supports_mrz AND coalesce(mrz_status, '') <> 'NOT_APPLICABLE')"
_OCR = "CASE WHEN ocr_status IN ('OK', 'SKIPPED') THEN 'PASS' WHEN ocr_status = 'ERROR' THEN 'FAIL' ELSE 'WARNING' END"
_READ = f"{_HASM} AND mrz_status IN ('PARSED', 'PARTIAL') AND "
RULES = ", ".join([
    row("image_quality", "CASE WHEN insufficient_for_analysis THEN 'FAIL' WHEN overall_quality < 0.45 THEN 'WARNING' ELSE 'PASS' END"),
    row("document_type", "CASE WHEN type_confidence < 0.35 OR document_type IN ('UNKNOWN', 'OTHER') THEN 'WARNING' ELSE 'PASS' END"),
    row("ocr", _OCR, f"CASE WHEN ({_OCR}) = 'PASS' THEN 'info' ELSE 'review' END"),
    row("field_completeness", "CASE WHEN field_completeness IS NULL THEN 'NOT_ASSESSED' WHEN field_completeness < 0.35 THEN 'WARNING' ELSE 'PASS' END"),
    row("mrz", f"CASE WHEN NOT {_HASM} THEN 'NOT_APPLICABLE' WHEN mrz_status IN ('NOT_DETECTED', 'PARTIAL') THEN 'WARNING' WHEN mrz_status = 'PARSED' THEN 'PASS' ELSE 'NOT_ASSESSED' END"),
    row("mrz_visible_name", "name_cmp", None, _READ + "name_cmp IS NOT NULL"),
    row("mrz_visible_date_of_birth", "dob_cmp", None, _READ + "true"), row("mrz_visible_document_number", "number_cmp", None, _READ + "true"),
    row("face_photo", "CASE WHEN NOT expects_photo THEN 'NOT_APPLICABLE' WHEN face_status = 'DETECTED' THEN 'PASS' WHEN face_status IS NULL THEN 'NOT_ASSESSED' ELSE 'WARNING' END"),
    row("liveness", "CASE WHEN pad_status = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN pad_decision LIKE 'SUSPECT%' THEN 'WARNING' WHEN pad_status = 'PASSIVE_ASSESSED' THEN CASE WHEN pad_decision LIKE 'PASSIVE_OK%' THEN 'PASS' ELSE 'WARNING' END ELSE 'NOT_ASSESSED' END",
        "CASE WHEN pad_status <> 'NOT_APPLICABLE' AND pad_decision LIKE 'SUSPECT%' THEN 'elevated' WHEN pad_status = 'PASSIVE_ASSESSED' AND pad_decision = 'INCONCLUSIVE' THEN 'review' ELSE 'info' END"),
    row("clip_type_alignment", "CASE clip_agreement WHEN 'ALIGNED' THEN 'PASS' WHEN 'PARTIAL' THEN 'WARNING' WHEN 'DIVERGENT' THEN 'WARNING' ELSE 'NOT_ASSESSED' END", "CASE clip_agreement WHEN 'DIVERGENT' THEN 'elevated' WHEN 'PARTIAL' THEN 'review' ELSE 'info' END"),
    row("head_agreement", "CASE WHEN enet_auth IS NULL THEN 'NOT_ASSESSED' WHEN abs(enet_auth - vit_auth) <= 0.2 THEN 'PASS' ELSE 'WARNING' END"),
    row("tampering_signals", "CASE WHEN tamper_status <> 'ANALYZED' THEN 'NOT_ASSESSED' WHEN severity = 'ELEVATED_REVIEW' THEN 'WARNING' ELSE 'PASS' END", "CASE WHEN tamper_status = 'ANALYZED' AND severity = 'ELEVATED_REVIEW' THEN 'elevated' ELSE 'info' END"),
    row("fusion", "CASE WHEN fusion_status = 'FUSED' THEN 'PASS' ELSE 'NOT_ASSESSED' END"),
    row("typography", "'WARNING'", None, "typography_anomalies > 0"),
    row("field_issue_after_dob", "'FAIL'", None, "doc_id % 23 = 0"),
    *[row(f"ocr_visual_f{i}", "'FAIL'" if i == 2 else "'WARNING'" if i == 3 else "'PASS'", None, "doc_id % 6 = 0") for i in range(1, 10)],
])
CHECKS = f"SELECT doc_id, u.item AS item, u.status AS status, u.severity AS severity FROM (SELECT doc_id, unnest(list_filter([{RULES}], lambda x: x IS NOT NULL)) AS u FROM ({EV_SQL}) e) z"
ROLL = f"""SELECT *, CASE WHEN nf > 0 THEN 'FAIL' WHEN nw > 0 THEN 'WARNING' ELSE 'PASS' END AS cv_overall, CASE WHEN nf > 0 OR nw >= 3 THEN 'elevated' WHEN nw > 0 THEN 'review' ELSE 'info' END AS cv_severity, round(np / (np + nf + nw) + 1e-9, 4) AS cv_pass_rate
FROM (SELECT doc_id, count_if(status = 'PASS') AS np, count_if(status = 'FAIL') AS nf, count_if(status = 'WARNING') AS nw FROM ({CHECKS}) c GROUP BY doc_id) r"""

query("cv_rules", CHECKS)(lambda s, sf: oe.checks(ev(s, sf)).drop("detail"))
query("set_checks_union", f"SELECT item, status, count(*) AS n FROM ({CHECKS}) c GROUP BY ALL")(
    lambda s, sf: oe.checks(ev(s, sf)).groupBy("item", "status").agg(F.count(F.lit(1)).alias("n")))
query("agg_check_rollup", f"SELECT doc_id, np AS n_pass, nf AS n_fail, nw AS n_warning, cv_overall, cv_severity, cv_pass_rate FROM ({ROLL}) r")(
    lambda s, sf: oe.rollup(oe.checks(ev(s, sf))).select("doc_id", "n_pass", "n_fail", "n_warning", "cv_overall", "cv_severity", "cv_pass_rate"))

_B = "CASE WHEN {0} THEN 1.0 ELSE 0.0 END"
_VIS = f"0.34 * {_B.format('enet_ok')} + 0.33 * {_B.format('vit_ok')} + 0.33 * {_B.format('clip_ok')}"
_FUS = "CASE WHEN fusion_status <> 'FUSED' OR fusion_authentic IS NULL THEN 0.45 WHEN head_agreement = 'AGREE' THEN least(1.0, 0.63 + 0.7 * abs(fusion_authentic - 0.5)) ELSE least(1.0, 0.55 + 0.7 * abs(fusion_authentic - 0.5)) END"
_CAL = "CASE calibration_status WHEN 'CALIBRATED' THEN 0.75 WHEN 'SKIPPED' THEN 0.25 ELSE 0.35 END"
EVR = f"SELECT e.*, r.np, r.nf, r.nw, r.cv_overall, r.cv_pass_rate FROM ({EV_SQL}) e JOIN ({ROLL}) r ON r.doc_id = e.doc_id"
CONF = f"""SELECT *, round(greatest(0.0, least(1.0, 0.28 * evidence_quality + 0.14 * type_confidence + 0.14 * coalesce(ocr_confidence, 0.35) + 0.10 * coalesce(field_completeness, 0.35) + 0.12 * ({_VIS}) + 0.10 * ({_FUS}) + 0.08 * coalesce(cv_pass_rate, 0.4) + 0.04 * ({_CAL})
 - CASE severity WHEN 'ELEVATED_REVIEW' THEN 0.08 ELSE 0.0 END)) + 1e-9, 4) AS confidence FROM ({EVR}) v"""


def checked(spark, sf):
    return oe.rollup_in_row(oe.checks_column(ev(spark, sf)))


@query("conf_factors", f"""SELECT doc_id, u.n AS name, u.w AS weight, round(u.v, 5) AS value FROM (SELECT doc_id, unnest([{{'n': 'evidence_quality', 'w': 0.28::DOUBLE, 'v': evidence_quality::DOUBLE}}, {{'n': 'document_type', 'w': 0.14, 'v': type_confidence}},
 {{'n': 'ocr', 'w': 0.14, 'v': coalesce(ocr_confidence, 0.35)}}, {{'n': 'field_completeness', 'w': 0.1, 'v': coalesce(field_completeness, 0.35)}}, {{'n': 'vision_backbones', 'w': 0.12, 'v': {_VIS}}}, {{'n': 'fusion', 'w': 0.1, 'v': {_FUS}}},
 {{'n': 'cross_validation', 'w': 0.08, 'v': coalesce(cv_pass_rate, 0.4)}}, {{'n': 'calibration', 'w': 0.04, 'v': {_CAL}}}]) AS u FROM ({EVR}) e) z""")
def q_factors(spark, sf):
    return oe.confidence(checked(spark, sf)).select("doc_id", F.inline("confidence_factors")).withColumn("value", F.round("value", 5))


query("agg_confidence", f"SELECT doc_id, confidence FROM ({CONF}) c")(lambda s, sf: oe.confidence(checked(s, sf)).select("doc_id", "confidence"))

_BAD, _NOOCR, _WEAK = "insufficient_for_analysis", "coalesce(ocr_status, '') = 'ERROR'", "coalesce(ocr_confidence < 0.35 AND fields_status = 'NO_FIELDS', false)"
PRIOR = f"""SELECT *, CASE WHEN {_BAD} OR {_NOOCR} OR {_WEAK} THEN 'INCONCLUSIVE' ELSE 'PENDING' END AS prior_decision,
 round(CASE WHEN {_BAD} THEN least(0.55, evidence_quality + 0.1) WHEN {_NOOCR} THEN least(0.6, 0.5 * evidence_quality + 0.3 * type_confidence) WHEN {_WEAK} THEN 0.4 * evidence_quality + 0.2 * coalesce(ocr_confidence, 0.0)
  ELSE least(0.92, 0.3 * evidence_quality + 0.2 * type_confidence + 0.2 * coalesce(nullif(ocr_confidence, 0), 0.4) + 0.1 * coalesce(nullif(mean_field_ocr_confidence, 0), 0.4) + 0.07 * {_B.format('enet_ok')} + 0.07 * {_B.format('vit_ok')} + 0.06 * {_B.format('clip_ok')}) END + 1e-9, 4) AS provisional_confidence FROM ({CONF}) c"""
query("prior_decision", f"SELECT doc_id, prior_decision, provisional_confidence FROM ({PRIOR}) p")(
    lambda s, sf: oe.prior_decision(checked(s, sf)).select("doc_id", "prior_decision", "provisional_confidence"))

_INS = "(insufficient_for_analysis OR (prior_decision = 'INCONCLUSIVE' AND authenticity_estimate IS NULL AND evidence_quality < 0.5))"
_FAKE = "(coalesce(authenticity_estimate < 0.28, false) OR coalesce(authenticity_estimate IS NULL AND fusion_tampered >= 0.72 AND (fusion_authentic IS NULL OR fusion_authentic < 0.35), false) OR (cv_overall = 'FAIL' AND nf >= 2))"
_AUTH = "(evidence_quality >= 0.5 AND severity <> 'ELEVATED_REVIEW' AND cv_overall <> 'FAIL' AND nf = 0 AND (coalesce(authenticity_estimate >= 0.55, false) OR (authenticity_estimate IS NULL AND confidence >= 0.45 AND severity = 'LOW_SIGNAL')))"
DOC = f"SELECT *, CASE WHEN {_INS} THEN 'INCONCLUSIVE' WHEN severity = 'ELEVATED_REVIEW' THEN 'TAMPERING_INDICATED' WHEN {_FAKE} THEN 'SUSPICIOUS' WHEN {_AUTH} THEN 'AUTHENTIC' ELSE 'INCONCLUSIVE' END AS doc_status FROM ({PRIOR}) p"


def judged(spark, sf):
    d = oe.confidence(oe.prior_decision(checked(spark, sf)))
    return od.document_verdict(d)


query("doc_verdict", f"SELECT doc_id, doc_status FROM ({DOC}) d")(lambda s, sf: judged(s, sf).select("doc_id", "doc_status"))

# Identity inputs: comparison results of every kind.
FACES = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'NOT_DETECTED' WHEN 1 THEN 'MULTIPLE_DETECTED' WHEN 8 THEN NULL ELSE 'DETECTED' END AS doc_face_status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'CAPTURED' END AS camera_status,
 CASE doc_id % 11 WHEN 0 THEN 'NOT_DETECTED' ELSE 'DETECTED' END AS live_face_status, CAST(CASE doc_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS live_face_count,
 CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NOT_ASSESSED' ELSE 'COMPARED_UNCALIBRATED' END AS ver_status, CASE doc_id % 5 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'match' WHEN 2 THEN 'MATCH_CANDIDATE' WHEN 3 THEN NULL ELSE 'HIGH_SIMILARITY' END AS ver_result,
 CAST(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 0.9 END AS DOUBLE) AS similarity, CASE WHEN doc_id % 17 = 0 THEN 'SAME_IMAGE_BYTES' ELSE 'DIFFERENT' END AS embedding_sources FROM {documents}"""
FACES_SQL = I.plain(FACES)
IDV = f"""SELECT *, CASE WHEN noface THEN 'FACE_NOT_DETECTED' WHEN res IN ('MATCH', 'NO_MATCH', 'INCONCLUSIVE') THEN res WHEN df IN ('DETECTED', 'MULTIPLE_DETECTED') AND NOT cap THEN 'AWAITING_LIVE' ELSE 'NOT_ASSESSED' END AS id_status FROM (
 SELECT *, CASE WHEN noface THEN 'NOT_AVAILABLE' WHEN r1 = 'MATCH' AND embedding_sources = 'SAME_IMAGE_BYTES' THEN 'INCONCLUSIVE' ELSE r1 END AS res FROM (
 SELECT *, CASE WHEN cap AND (live_face_count = 0 OR live_face_status = 'NOT_DETECTED') THEN 'NO_MATCH' WHEN live_face_count > 1 OR (r0 = 'MATCH' AND (coalesce(ver_status, '') <> 'COMPARED_UNCALIBRATED' OR similarity IS NULL)) THEN 'INCONCLUSIVE' ELSE r0 END AS r1 FROM (
 SELECT *, df = 'NOT_DETECTED' AND NOT cap AS noface, CASE WHEN rr IN ('MATCH', 'NO_MATCH') THEN rr WHEN coalesce(ver_status, 'NOT_ASSESSED') = 'NOT_ASSESSED' THEN 'NOT_AVAILABLE' ELSE 'INCONCLUSIVE' END AS r0 FROM (
 SELECT *, coalesce(camera_status = 'CAPTURED', false) AS cap, coalesce(doc_face_status, 'NOT_ASSESSED') AS df, regexp_replace(upper(ver_result), '_CANDIDATE$', '') AS rr FROM ({FACES_SQL}) f) a) b) c) d"""
query("id_verdict", f"SELECT doc_id, id_status, res AS id_result FROM ({IDV}) i")(
    lambda s, sf: od.identity_verdict(I.derive(s, sf, FACES)).select("doc_id", "id_status", "id_result"))

FUSEV = f"""SELECT j.*, CASE WHEN doc_status = 'AUTHENTIC' AND id_status = 'MATCH' AND similarity IS NOT NULL THEN 'PASS' WHEN doc_status IN ('TAMPERING_INDICATED', 'SUSPICIOUS') THEN 'HIGH-RISK' ELSE 'INCONCLUSIVE' END AS decision,
 CASE WHEN doc_status = 'AUTHENTIC' AND id_status = 'MATCH' AND similarity IS NOT NULL THEN 'PASS_AUTHENTIC' WHEN doc_status IN ('TAMPERING_INDICATED', 'SUSPICIOUS') THEN doc_status ELSE 'INCONCLUSIVE' END AS officer_code
FROM (SELECT d.*, i.id_status, i.res, i.similarity, i.cap FROM ({DOC}) d JOIN ({IDV}) i ON i.doc_id = d.doc_id) j"""


def both(spark, sf):
    drop = ["face_status", "pad_decision"]
    return judged(spark, sf).drop(*drop).join(I.derive(spark, sf, FACES), "doc_id")


query("fuse_verdict", f"SELECT doc_id, decision, officer_code FROM ({FUSEV}) f")(
    lambda s, sf: od.fuse_verdict(od.identity_verdict(both(s, sf))).select("doc_id", "decision", "officer_code"))

_EARLY = "(prior_decision = 'INCONCLUSIVE' AND doc_status = 'INCONCLUSIVE' AND id_status IN ('NOT_ASSESSED', 'INCONCLUSIVE', 'FACE_NOT_DETECTED', 'AWAITING_LIVE') AND authenticity_estimate IS NULL AND evidence_quality < 0.45)"
DECIDED = f"""SELECT *, {_EARLY} AS early FROM ({FUSEV}) f"""


@query("decide", f"""SELECT doc_id, decision, CASE WHEN early THEN 'Insufficient evidence for a reliable automated decision.' WHEN officer_code = 'PASS_AUTHENTIC' THEN 'pass' WHEN officer_code <> 'INCONCLUSIVE' THEN 'risk' ELSE 'other' END AS kind,
 CASE WHEN early THEN 'Prior screening marked insufficient evidence/image quality.' ELSE 'Document evidence: ' || doc_status || '.' END AS first_reason FROM ({DECIDED}) d""")
def q_decide(spark, sf):
    d = od.decide(both(spark, sf))
    early = F.col("verdict_summary").startswith("Insufficient evidence for a reliable")
    return d.select("doc_id", "decision", F.when(early, F.col("verdict_summary")).when(F.col("officer_code") == "PASS_AUTHENTIC", F.lit("pass"))
                    .when(F.col("officer_code") != "INCONCLUSIVE", F.lit("risk")).otherwise(F.lit("other")).alias("kind"),
                    F.col("decision_reasons")[0].alias("first_reason"))


@query("set_reasons", f"""SELECT doc_id, CASE WHEN early THEN 2 ELSE 3 + n END AS n_reasons FROM (SELECT *, CASE WHEN cv_overall = 'FAIL' THEN 1 ELSE 0 END + CASE WHEN {_INS} THEN 1 ELSE 0 END + CASE WHEN doc_status IN ('TAMPERING_INDICATED', 'SUSPICIOUS') THEN 1 ELSE 0 END AS n FROM ({DECIDED}) d WHERE id_status = 'MATCH' AND doc_status <> 'TAMPERING_INDICATED') e""")
def q_reasons(spark, sf):
    d = od.decide(both(spark, sf)).filter("id_status = 'MATCH' AND doc_status <> 'TAMPERING_INDICATED'")
    return d.select("doc_id", F.size("decision_reasons").alias("n_reasons"))


@query("refine_identity", f"""SELECT f.doc_id, CASE WHEN ds = 'AUTHENTIC' AND id_status = 'MATCH' AND similarity IS NOT NULL THEN 'PASS' WHEN ds IN ('TAMPERING_INDICATED', 'SUSPICIOUS') THEN 'HIGH-RISK' ELSE 'INCONCLUSIVE' END AS decision, id_status
FROM ({IDV}) f JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AUTHENTIC' WHEN 1 THEN 'SUSPICIOUS' ELSE CASE WHEN doc_id % 2 = 0 THEN 'AUTHENTIC' ELSE 'INCONCLUSIVE' END END AS ds FROM documents) d ON d.doc_id = f.doc_id""")
def q_refine(spark, sf):
    # Two stored versions per document, the later one counts; every third has signals only.
    base = I.table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id") % 3
    newer = base.select("doc_id", F.lit(2).alias("decided_at"), F.when(k == 0, F.lit("AUTHENTIC")).when(k == 1, F.lit("SUSPICIOUS")).alias("doc_status"),
                        F.lit("LOW_SIGNAL").alias("severity"), F.when((k == 2) & (F.col("doc_id") % 2 == 0), 0.8).when(k == 2, 0.5).alias("authenticity_estimate"))
    older = base.select("doc_id", F.lit(1).alias("decided_at"), F.lit("INCONCLUSIVE").alias("doc_status"), F.lit("LOW_SIGNAL").alias("severity"), F.lit(0.1).alias("authenticity_estimate"))
    return od.refine_identity(newer.unionByName(older), I.derive(spark, sf, FACES)).select("doc_id", "decision", "id_status")


OFF = "CASE decision WHEN 'HIGH-RISK' THEN 'HIGH' WHEN 'PASS' THEN 'LOW' ELSE 'INCONCLUSIVE' END"


@query("officer_label", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN officer_code WHEN decision = 'PASS' THEN 'PASS_AUTHENTIC' WHEN decision = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' WHEN severity = 'ELEVATED_REVIEW' THEN 'TAMPERING_INDICATED' ELSE 'SUSPICIOUS' END AS key,
 CASE decision WHEN 'PASS' THEN 'ok' WHEN 'HIGH-RISK' THEN 'danger' ELSE 'muted' END AS tone, {OFF} AS evidence_level, CASE cv_overall WHEN 'PASS' THEN 'ok' WHEN 'WARNING' THEN 'warn' ELSE 'fail' END AS cv_mark,
 CASE decision WHEN 'HIGH-RISK' THEN 'fail' WHEN 'INCONCLUSIVE' THEN 'warn' ELSE 'ok' END AS result_mark FROM ({FUSEV}) f""")
def q_officer(spark, sf):
    d = od.fuse_verdict(od.identity_verdict(both(spark, sf))).withColumn("tamper_flags", F.array().cast("array<string>"))
    d = d.withColumn("officer_label", F.when(F.col("doc_id") % 2 == 0, F.col("officer_label")))
    return od.officer_view(d).select("doc_id", "key", "tone", "evidence_level", "cv_mark", "result_mark")


@query("join_evidence", f"SELECT doc_id, cv_overall, confidence, document_type FROM ({CONF}) c")
def q_join(spark, sf):
    e = oe.confidence(checked(spark, sf))
    docs = I.table(spark, sf, "documents").select("doc_id")
    parts = [e.select("doc_id", "cv_overall"), e.select("doc_id", "confidence"), e.select("doc_id", "document_type")]
    return oe.join_evidence(docs, parts).select("doc_id", "cv_overall", "confidence", "document_type")


@query("agg_module_errors", f"""SELECT doc_id, string_agg(module || '=' || error, ',' ORDER BY module) AS errors FROM (
 SELECT doc_id, 'ocr' AS module, 'ERROR' AS error FROM ({EV_SQL}) e WHERE ocr_status = 'ERROR' UNION ALL SELECT doc_id, 'tampering', 'ERROR' FROM ({EV_SQL}) e WHERE tamper_status = 'ERROR') x GROUP BY doc_id""")
def q_errors(spark, sf):
    d = ev(spark, sf)
    rows = d.select("doc_id", F.inline(F.array_compact(F.array(*[
        F.when(F.col(c) == "ERROR", F.struct(F.lit(m).alias("module"), F.col(c).alias("error"))) for m, c in (("ocr", "ocr_status"), ("tampering", "tamper_status"))]))))
    m = oe.module_errors(rows)
    return m.select("doc_id", F.array_join(F.transform(F.map_entries("module_errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("errors"))


@query("phase_status", f"SELECT doc_id, coalesce(ocr_status, 'NOT_ASSESSED') AS ocr, coalesce(mrz_status, 'NOT_ASSESSED') AS mrz, CASE WHEN fusion_status = 'FUSED' THEN '✓ ' ELSE '○ ' END || 'Feature fusion' AS mark FROM ({EV_SQL}) e")
def q_phase(spark, sf):
    d = oe.trace(oe.status_map(ev(spark, sf), ["ocr_status", "mrz_status"]), {"Feature fusion": F.col("fusion_status") == "FUSED"})
    return d.select("doc_id", F.col("phase_status")["ocr_status"].alias("ocr"), F.col("phase_status")["mrz_status"].alias("mrz"), F.col("trace")[0].alias("mark"))


@query("explain_snapshot", f"SELECT doc_id, coalesce(round(enet_auth, 5), -1.0) AS enet, coalesce(clip_agreement, '') AS clip, 8 AS n_factors FROM ({EV_SQL}) e")
def q_explain(spark, sf):
    d = oe.explain(oe.confidence(checked(spark, sf)))
    return d.select("doc_id", F.coalesce(F.round("explainability.efficientnet_auth", 5), F.lit(-1.0)).alias("enet"),
                    F.coalesce("explainability.clip_alignment", F.lit("")).alias("clip"), F.size("explainability.confidence_factors").alias("n_factors"))


# --- the flagship: every document screened, newest cases listed -----------------------------

_SCREEN = """SELECT doc_id, evidence_quality, authenticity_estimate, severity, CAST(CASE doc_id % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'AWAITING_LIVE' ELSE 'FACE_NOT_DETECTED' END AS STRING) AS identity, CAST(1 AS DOUBLE) AS field_completeness FROM
 (SELECT d.doc_id, CAST(round(least(1.0, CAST(n_chars AS DOUBLE) / 2000.0), 4) AS DOUBLE) AS evidence_quality, CAST(CASE quality WHEN 1 THEN 0.7 WHEN 0 THEN 0.2 END AS DOUBLE) AS authenticity_estimate, CASE toxic WHEN 1 THEN 'ELEVATED_REVIEW' WHEN 0 THEN 'LOW_SIGNAL' ELSE 'NOT_ASSESSED' END AS severity
  FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) e"""


def screened(spark, sf):
    d = I.derive(spark, sf, _SCREEN).withColumns({
        "overall_quality": F.col("evidence_quality"), "ocr_status": F.lit("OK"), "tamper_status": F.lit("ANALYZED"),
        "doc_face_status": F.when(F.col("identity") == "FACE_NOT_DETECTED", F.lit("NOT_DETECTED")).otherwise(F.lit("DETECTED")),
        "camera_status": F.when(F.col("identity").isin("MATCH", "NO_MATCH"), F.lit("CAPTURED")),
        "live_face_status": F.lit("DETECTED"), "live_face_count": F.lit(1).cast("long"),
        "ver_status": F.when(F.col("identity").isin("MATCH", "NO_MATCH"), F.lit("COMPARED_UNCALIBRATED")),
        "ver_result": F.when(F.col("identity").isin("MATCH", "NO_MATCH"), F.col("identity")),
        "similarity": F.when(F.col("identity") == "MATCH", 0.97).when(F.col("identity") == "NO_MATCH", 0.4)})
    return od.decide(oe.confidence(oe.prior_decision(oe.rollup_in_row(oe.checks_column(d)))))


_W1 = "(CASE WHEN evidence_quality < 0.45 THEN 1 ELSE 0 END)"
SCREEN = f"""SELECT *, CASE WHEN doc_status = 'AUTHENTIC' AND identity = 'MATCH' THEN 'PASS' WHEN doc_status IN ('TAMPERING_INDICATED', 'SUSPICIOUS') THEN 'HIGH-RISK' ELSE 'INCONCLUSIVE' END AS decision FROM (
 SELECT *, CASE WHEN severity = 'ELEVATED_REVIEW' THEN 'TAMPERING_INDICATED' WHEN authenticity_estimate < 0.28 THEN 'SUSPICIOUS' WHEN evidence_quality >= 0.5 AND authenticity_estimate >= 0.55 THEN 'AUTHENTIC' ELSE 'INCONCLUSIVE' END AS doc_status,
  round(greatest(0.0, least(1.0, 0.28 * evidence_quality + 0.14 * 0 + 0.14 * 0.35 + 0.1 * 1.0 + 0.12 * 0 + 0.1 * 0.45 + 0.08 * round(np / (np + nw) + 1e-9, 4) + 0.04 * 0.35 - CASE severity WHEN 'ELEVATED_REVIEW' THEN 0.08 ELSE 0 END)) + 1e-9, 4) AS confidence
 FROM (SELECT *, CASE WHEN evidence_quality < 0.45 THEN 0 ELSE 1 END + 2 + CASE WHEN severity = 'ELEVATED_REVIEW' THEN 0 ELSE 1 END AS np, {_W1} + CASE WHEN severity = 'ELEVATED_REVIEW' THEN 1 ELSE 0 END AS nw FROM ({I.plain(_SCREEN)}) s) s1) s2"""


@query("screen_cases", f"SELECT doc_id, doc_status, identity AS id_status, decision, confidence FROM ({SCREEN}) s")
def q_screen(spark, sf):
    d = screened(spark, sf)
    return d.select("doc_id", "doc_status", "id_status", "decision", "confidence")


@query("screen_all", f"SELECT doc_status, identity AS id_status, decision, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM ({SCREEN}) s GROUP BY ALL")
def q_screen_all(spark, sf):
    return screened(spark, sf).groupBy("doc_status", "id_status", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
