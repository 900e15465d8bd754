"""Cross-checks between sources, support confidence, and the provisional decision.

Everything here is a projection over one row per document: the checks of a
document are built as one array and exploded, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, clip01, r
from idsieve.functions.fixed import CONFIDENCE_WEIGHTS, QUALITY_MIN

STATUSES = ("PASS", "FAIL", "WARNING", "NOT_ASSESSED", "NOT_APPLICABLE")

CHECK_COLUMNS = {
    "insufficient_for_analysis": "boolean", "overall_quality": "double", "document_type": "string",
    "type_confidence": "double", "ocr_status": "string", "field_completeness": "double",
    "date_checks": "array<struct<check:string,status:string>>", "supports_mrz": "boolean",
    "mrz_status": "string", "name_cmp": "string", "dob_cmp": "string", "number_cmp": "string",
    "expects_photo": "boolean", "face_status": "string", "pad_status": "string",
    "pad_decision": "string", "clip_agreement": "string", "enet_auth": "double",
    "vit_auth": "double", "tamper_status": "string", "severity": "string", "fusion_status": "string",
    "ocr_visual": "array<struct<field:string,status:string>>", "typography_anomalies": "int",
}


def with_missing(d: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Modules that did not run are null columns, never defaults."""
    return d.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in d.columns})


def _severity(status: Column) -> Column:
    return case((status == "FAIL", "elevated"), (status == "WARNING", "review"), otherwise="info")


def _row(item: str | Column, status: Column, severity: Column | None = None,
         detail: Column | None = None) -> Column:
    name = item if isinstance(item, Column) else F.lit(item)
    return F.struct(
        name.alias("item"), status.alias("status"),
        (_severity(status) if severity is None else severity).alias("severity"),
        F.coalesce(F.lit("") if detail is None else detail, F.lit("")).alias("detail"))


def checks_column(d: DataFrame) -> DataFrame:
    """Add ``checks``: the array of all check rows of a document."""
    c = F.col
    d = with_missing(d, CHECK_COLUMNS)
    insufficient = F.coalesce("insufficient_for_analysis", F.lit(False))
    quality = case(
        (insufficient, "FAIL"), (c("overall_quality") < QUALITY_MIN, "WARNING"),
        (c("overall_quality").isNotNull(), "PASS"), otherwise="NOT_ASSESSED")
    label = F.upper(F.coalesce("document_type", F.lit("UNKNOWN")))
    doc_type = case(
        (c("type_confidence").isNull(), "NOT_ASSESSED"),
        ((c("type_confidence") < 0.35) | label.isin("UNKNOWN", "OTHER"), "WARNING"), otherwise="PASS")
    ocr_ok = F.coalesce(c("ocr_status").isin("OK", "SKIPPED"), F.lit(False))
    ocr = case((ocr_ok, "PASS"), (c("ocr_status") == "ERROR", "FAIL"), otherwise="WARNING")
    complete = case((c("field_completeness").isNull(), "NOT_ASSESSED"),
                    (c("field_completeness") < 0.35, "WARNING"), otherwise="PASS")
    has_mrz = F.coalesce("supports_mrz", F.lit(False)) & ~F.coalesce(
        c("mrz_status") == "NOT_APPLICABLE", F.lit(False))
    mrz = case(
        (~has_mrz, "NOT_APPLICABLE"), (c("mrz_status").isin("NOT_DETECTED", "PARTIAL"), "WARNING"),
        (c("mrz_status") == "PARSED", "PASS"), otherwise="NOT_ASSESSED")
    photo = case(
        (~F.coalesce("expects_photo", F.lit(False)), "NOT_APPLICABLE"),
        (c("face_status") == "DETECTED", "PASS"),
        (c("face_status").isin("MULTIPLE_DETECTED", "NOT_DETECTED"), "WARNING"), otherwise="NOT_ASSESSED")
    suspect = c("pad_decision") == "SUSPECT_PRESENTATION_ATTACK"
    live = case(
        (c("pad_status") == "NOT_APPLICABLE", "NOT_APPLICABLE"), (suspect, "WARNING"),
        ((c("pad_status") == "PASSIVE_ASSESSED") & (c("pad_decision") == "PASSIVE_OK_UNCALIBRATED"), "PASS"),
        (c("pad_status") == "PASSIVE_ASSESSED", "WARNING"), otherwise="NOT_ASSESSED")
    live_sev = case((suspect & (c("pad_status") != "NOT_APPLICABLE"), "elevated"),
                    ((c("pad_status") == "PASSIVE_ASSESSED") & (c("pad_decision") == "INCONCLUSIVE"), "review"),
                    otherwise="info")
    agree = F.upper("clip_agreement")
    clip = case((agree == "ALIGNED", "PASS"), (agree.isin("PARTIAL", "DIVERGENT"), "WARNING"),
                otherwise="NOT_ASSESSED")
    clip_sev = case((agree == "DIVERGENT", "elevated"), (agree == "PARTIAL", "review"), otherwise="info")
    gap = F.abs(c("enet_auth") - c("vit_auth"))
    heads = case((gap.isNull(), "NOT_ASSESSED"), (gap <= 0.20, "PASS"), otherwise="WARNING")
    analyzed = F.coalesce(c("tamper_status") == "ANALYZED", F.lit(False))
    elevated = analyzed & F.coalesce(c("severity") == "ELEVATED_REVIEW", F.lit(False))
    tamper = case((elevated, "WARNING"), (analyzed, "PASS"), otherwise="NOT_ASSESSED")
    fusion = case((c("fusion_status") == "FUSED", "PASS"), otherwise="NOT_ASSESSED")
    typo = F.when(c("typography_anomalies") > 0, _row("typography", F.lit("WARNING")))

    def visible(key: str, col: str) -> Column:
        known = c(col).isin("PASS", "FAIL", "WARNING")
        read = has_mrz & c("mrz_status").isin("PARSED", "PARTIAL") & c(col).isNotNull()
        return F.when(read, _row(f"mrz_visible_{key}",
                                 F.when(known, c(col)).otherwise(F.lit("NOT_ASSESSED"))))

    fixed = F.array_compact(F.array(
        _row("image_quality", quality, detail=F.format_string("quality=%.4f", F.col("overall_quality").cast("double"))),
        _row("document_type", doc_type, detail=F.concat(F.lit("type="), label)),
        _row("ocr", ocr, case((ocr == "PASS", "info"), otherwise="review"),
             F.concat(F.lit("status="), c("ocr_status"))),
        _row("field_completeness", complete), _row("mrz", mrz, detail=c("mrz_status")),
        visible("name", "name_cmp"), visible("date_of_birth", "dob_cmp"),
        visible("document_number", "number_cmp"),
        _row("face_photo", photo, detail=c("face_status")), _row("liveness", live, live_sev, c("pad_decision")),
        _row("clip_type_alignment", clip, clip_sev, c("clip_agreement")), _row("head_agreement", heads),
        _row("tampering_signals", tamper,
             case((elevated, "elevated"), otherwise="info"), c("severity")),
        _row("fusion", fusion, detail=c("fusion_status")), typo))
    kind = "array<struct<item:string,status:string,severity:string,detail:string>>"
    none = F.array().cast(kind)
    dates = F.transform(F.filter("date_checks", lambda x: x["status"].isin("FAIL", "WARNING")),
                        lambda x: _row(F.concat(F.lit("field_"), x["check"]), x["status"]))

    def region(x: Column) -> Column:
        st = case((x["status"] == "CONSISTENT", "PASS"), (x["status"] == "INCONSISTENT", "FAIL"),
                  (x["status"].isin("UNCERTAIN", "NOT_FOUND"), "WARNING"), otherwise="NOT_ASSESSED")
        return _row(F.concat(F.lit("ocr_visual_"), x["field"]), st)

    visual = F.transform("ocr_visual", region)
    return d.withColumn("checks", F.concat(
        fixed.cast(kind), F.coalesce(dates.cast(kind), none), F.coalesce(visual.cast(kind), none)))


def checks(d: DataFrame) -> DataFrame:
    """Long form: doc_id, item, status, severity, detail."""
    return checks_column(d).select("doc_id", F.inline("checks"))


def _overall(n_fail: Column, n_warn: Column) -> tuple[Column, Column]:
    return (
        case((n_fail > 0, "FAIL"), (n_warn > 0, "WARNING"), otherwise="PASS"),
        case((n_fail > 0, "elevated"), (n_warn >= 3, "elevated"), (n_warn > 0, "review"), otherwise="info"),
    )


def _rate(ok: Column, fail: Column, warn: Column) -> Column:
    return r(F.try_divide(ok, ok + fail + warn))


def rollup(long_checks: DataFrame) -> DataFrame:
    """Counts per status, overall label and severity, pass rate (null without scored checks)."""
    n = {s: F.count_if(F.col("status") == s).alias("n_" + s.lower()) for s in STATUSES}
    d = long_checks.groupBy("doc_id").agg(*n.values())
    return _with_rollup(d)


def rollup_in_row(d: DataFrame) -> DataFrame:
    """The same over the ``checks`` array, without exploding it."""

    def count(s: str) -> Column:
        return F.size(F.filter("checks", lambda x: x["status"] == s)).cast("long")

    return _with_rollup(d.withColumns({"n_" + s.lower(): count(s) for s in STATUSES}))


def _with_rollup(d: DataFrame) -> DataFrame:
    ok, fail, warn = F.col("n_pass"), F.col("n_fail"), F.col("n_warning")
    overall, severity = _overall(fail, warn)
    return d.withColumns({
        "cv_overall": overall, "cv_severity": severity, "cv_pass_rate": _rate(ok, fail, warn)})


# --- confidence ---------------------------------------------------------------------

CONFIDENCE_COLUMNS = {
    "evidence_quality": "double", "type_confidence": "double", "ocr_confidence": "double",
    "field_completeness": "double", "enet_ok": "boolean", "vit_ok": "boolean", "clip_ok": "boolean",
    "fusion_status": "string", "fusion_authentic": "double", "head_agreement": "string",
    "cv_pass_rate": "double", "calibration_status": "string", "severity": "string",
}


def confidence(d: DataFrame) -> DataFrame:
    """Add ``confidence_factors`` (name, weight, value), ``tampering_penalty``, ``confidence``."""
    c = F.col
    d = with_missing(d, CONFIDENCE_COLUMNS)

    def has(col: str) -> Column:
        return F.coalesce(c(col), F.lit(False)).cast("double")

    fused = (c("fusion_status") == "FUSED") & c("fusion_authentic").isNotNull()
    decisive = 0.55 + 0.35 * F.abs(c("fusion_authentic") - 0.5) * 2
    bonus = F.when(c("head_agreement") == "AGREE", F.least(F.lit(1.0), decisive + 0.08)).otherwise(decisive)
    values = {
        "evidence_quality": clip01(c("evidence_quality")),
        "document_type": clip01(c("type_confidence")),
        "ocr": clip01(F.coalesce("ocr_confidence", F.lit(0.35))),
        "field_completeness": clip01(F.coalesce("field_completeness", F.lit(0.35))),
        "vision_backbones": 0.34 * has("enet_ok") + 0.33 * has("vit_ok") + 0.33 * has("clip_ok"),
        "fusion": clip01(F.when(fused, bonus).otherwise(0.45)),
        "cross_validation": clip01(F.coalesce("cv_pass_rate", F.lit(0.4))),
        "calibration": case((c("calibration_status") == "CALIBRATED", 0.75),
                            (c("calibration_status") == "SKIPPED", 0.25), otherwise=0.35),
    }
    d = d.withColumns({
        "confidence_factors": F.array(*[
            F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), values[n].alias("value"))
            for n, w in CONFIDENCE_WEIGHTS.items()]),
        "tampering_penalty": case((c("severity") == "ELEVATED_REVIEW", 0.08),
                                  (c("severity").isin("MODERATE_REVIEW", "MODERATE"), 0.04), otherwise=0.0),
    })
    total = F.aggregate("confidence_factors", F.lit(0.0), lambda a, f: a + f["weight"] * f["value"])
    return d.withColumn("confidence", r(clip01(total - c("tampering_penalty"))))


# --- provisional decision --------------------------------------------------------------

PRIOR_COLUMNS = {
    "insufficient_for_analysis": "boolean", "reason": "string", "evidence_quality": "double",
    "document_type": "string", "type_confidence": "double", "ocr_status": "string",
    "ocr_confidence": "double", "fields_status": "string", "field_count": "long",
    "field_completeness": "double", "mean_field_ocr_confidence": "double", "mrz_status": "string",
    "enet_ok": "boolean", "vit_ok": "boolean", "clip_ok": "boolean", "fusion_status": "string",
    "severity": "string", "face_status": "string", "cv_overall": "string",
}


def prior_decision(d: DataFrame) -> DataFrame:
    """Add prior_decision (PENDING or INCONCLUSIVE), provisional_confidence and prior_reasons."""
    c = F.col
    d = with_missing(d, PRIOR_COLUMNS)
    bad = F.coalesce("insufficient_for_analysis", F.lit(False))
    no_ocr = F.coalesce(c("ocr_status").isin("NOT_ASSESSED", "ERROR"), F.lit(False))
    weak = F.coalesce((c("ocr_confidence") < 0.35) & (c("fields_status") == "NO_FIELDS"), F.lit(False))
    q = F.coalesce("evidence_quality", F.lit(0.0))
    t = F.coalesce("type_confidence", F.lit(0.0))

    def has(col: str) -> Column:
        return F.coalesce(c(col), F.lit(False)).cast("double")

    def or_default(col: str, x: float) -> Column:
        # Zero counts as missing here, as the screening rules state.
        return F.coalesce(F.nullif(c(col), F.lit(0.0)), F.lit(x))

    full = (0.30 * q + 0.20 * t + 0.20 * or_default("ocr_confidence", 0.4)
            + 0.10 * or_default("mean_field_ocr_confidence", 0.4)
            + 0.07 * has("enet_ok") + 0.07 * has("vit_ok") + 0.06 * has("clip_ok"))
    conf = case(
        (bad, F.least(F.lit(0.55), q + 0.1)), (no_ocr, F.least(F.lit(0.6), 0.5 * q + 0.3 * t)),
        (weak, 0.4 * q + 0.2 * F.coalesce("ocr_confidence", F.lit(0.0))),
        otherwise=F.least(F.lit(0.92), full))
    pending = ~bad & ~no_ocr & ~weak
    text = F.array_compact(F.array(
        F.when(bad, F.coalesce("reason", F.lit("Image quality is insufficient for reliable analysis."))),
        F.when(~bad & no_ocr, F.when(c("ocr_status") == "ERROR", F.lit("OCR module returned ERROR."))
               .otherwise(F.lit("OCR could not be assessed."))),
        F.when(~bad & ~no_ocr & weak, F.lit("OCR confidence too low and no fields extracted.")),
        F.when(pending, F.concat(F.lit("Document classified as "), F.coalesce("document_type", F.lit("UNKNOWN")),
                                 F.lit("."))),
        F.when(pending & (c("field_count") > 0), F.concat(
            F.lit("Extracted "), c("field_count").cast("string"), F.lit(" masked field(s) via OCR."))),
        F.when(pending & (F.coalesce("field_count", F.lit(0)) == 0),
               F.lit("OCR ran but no high-confidence identity fields were extracted.")),
        F.when(pending & c("mrz_status").isNotNull(), F.concat(F.lit("MRZ: "), c("mrz_status"), F.lit("."))),
        F.when(pending & c("severity").isNotNull(), F.concat(
            F.lit("Tampering heuristics: "), c("severity"), F.lit(" — review signals only."))),
        F.when(pending & c("face_status").isNotNull(), F.concat(
            F.lit("Face detection: "), c("face_status"), F.lit(" — detection only."))),
        F.when(c("cv_overall").isNotNull() & (bad | pending), F.concat(
            F.lit("Cross-validation: overall="), c("cv_overall"), F.lit(" — review only."))),
    ))
    return d.withColumns({
        "prior_decision": F.when(pending, F.lit("PENDING")).otherwise(F.lit("INCONCLUSIVE")),
        "provisional_confidence": r(conf), "prior_reasons": text,
    })


def join_evidence(docs: DataFrame, modules: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Left joins of one-row-per-document module outputs. Equal key, so one exchange per input
    (none where the tables are bucketed by the key). Both sides grow with the documents, so they are merged:
    one broadcast for each module would be held by the driver all at once."""
    out = docs
    for m in modules:
        out = out.join(m.hint("merge"), key, "left")
    return out


def module_errors(errors: DataFrame) -> DataFrame:
    """errors(doc_id, module, error) -> one map per document. Modules are a short fixed list;
    repeats of one module are folded before they are gathered."""
    one = errors.groupBy("doc_id", "module").agg(F.max("error").alias("error"))
    return one.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "error")))).alias("module_errors"))


def merge_reasons(base: Column, more: Column) -> Column:
    """Append what is not already there, keeping order."""
    return F.array_union(base, more)


def status_map(d: DataFrame, columns: list[str]) -> DataFrame:
    entries = [x for c in columns for x in (F.lit(c), F.coalesce(F.col(c), F.lit("NOT_ASSESSED")))]
    return d.withColumn("phase_status", F.create_map(*entries))


def trace(d: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Marked list of the steps that ran."""
    return d.withColumn("trace", F.array(*[
        F.concat(F.when(F.coalesce(ok, F.lit(False)), F.lit("✓ ")).otherwise(F.lit("○ ")), F.lit(name))
        for name, ok in steps.items()]))


def explain(d: DataFrame) -> DataFrame:
    """Relative model signals next to each other."""
    return d.withColumn("explainability", F.struct(
        F.col("enet_auth").alias("efficientnet_auth"), F.col("vit_auth"),
        F.col("fusion_authentic").alias("fusion_auth_raw"),
        F.col("authenticity_estimate").alias("authenticity_estimate_proxy"),
        F.col("clip_agreement").alias("clip_alignment"), F.col("confidence_factors")))
