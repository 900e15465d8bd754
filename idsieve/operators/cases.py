"""Cases, reports and their tables. The case log is append-only; views pick the newest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.functions.fixed import BANNER, DISCLAIMER
from idsieve.operators.audit import by_case
from idsieve.operators.ordered import last_per_key, number_in_order, top_k_per_key

CASE_PREFIX = "DS"
SHOWN = "N/A"


def allocate_ids(intake: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """intake(doc_id, submitted_at) -> case_id = prefix-year-number, numbered by arrival per year.

    Numbering adds the offsets of ranges of about equal size to the place within the range, so that no
    task sorts a whole year, nor a busy minute. ``existing(year, taken)``, one row a year, holds numbers already given.
    """
    d = intake.withColumn("year", F.year("submitted_at"))
    d = number_in_order(d, ["year"], [F.col("submitted_at"), F.col("doc_id")])
    if existing is not None:
        d = d.join(existing.groupBy("year").agg(F.max("taken").alias("taken")), "year", "left").withColumn(
            "seq", F.col("seq") + F.coalesce("taken", F.lit(0))).drop("taken")
    return d.withColumn("case_id", F.format_string(f"{CASE_PREFIX}-%d-%06d", F.col("year"), F.col("seq")))


def pending_cases(intake: DataFrame) -> DataFrame:
    """New cases before analysis."""
    return intake.withColumns({
        "document_type": F.lit("UNKNOWN"), "decision": F.lit("PENDING"), "evidence_json": F.lit("{}"),
        "reviewer_status": F.lit("OPEN"), "updated_at": F.col("submitted_at"),
    })


def append_cases(cases: DataFrame, path: str) -> None:
    """Append case versions, partitioned by the month of submission."""
    cases.withColumn("month", F.date_format("submitted_at", "yyyy-MM")).write.mode("append").partitionBy(
        "month").parquet(path)


def current_cases(log: DataFrame) -> DataFrame:
    """Newest version per case, by partial aggregation."""
    return last_per_key(log, ["case_id"], F.col("updated_at"))


def shown(score: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", score), F.lit(SHOWN))


def case_summary(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id", "document_type", "decision",
        *[F.when(F.col(c).isNull(), F.lit(SHOWN)).otherwise(F.format_string("%.4f", F.col(c))).alias(c)
          for c in ("authenticity_estimate", "confidence", "evidence_quality")],
        "reviewer_status")


def newest(cases: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` newest cases: by year, then by number, whatever its count of digits."""
    parts = F.split("case_id", "-")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    return cases.orderBy(F.desc_nulls_last(number(-2)), F.desc_nulls_last(number(-1)), F.desc("case_id")).limit(limit)


def parsed_evidence(text: Column) -> Column:
    """VARIANT of the stored evidence; text that is not JSON reads as an empty object."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def evidence_value(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def case_detail(cases: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases with their audit events as rows in order: all, or a first page of ``limit`` per case.

    Each row has its ``rank`` and the case's ``n_events``; a case without events is one row without a rank. A busy
    case is many rows, never one value.
    """
    n = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))
    rows = by_case(events, limit).select("case_id", "rank", "id", "action", "actor", "summary", "entry_hash")
    return cases.join(n, "case_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long"))).join(rows, "case_id", "left")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all cases that were appended."""
    return spark.read.parquet(path).drop("month")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, json, markdown) of written reports."""
    part = lambda kind: spark.read.parquet(f"{path}/{kind}").select("case_id", F.col("value").alias(kind))
    return part("json").join(part("markdown"), "case_id")


# Name shown in the report and path in the evidence.
EVIDENCE_SUMMARY = {
    "ocr_status": "$.ocr.status", "mrz_status": "$.mrz.status", "fusion_status": "$.fusion.status",
    "tampering_severity": "$.tampering.severity", "face_status": "$.face.status",
    "cross_validation": "$.cross_validation.overall", "calibration": "$.calibration.status",
}

def number(text: Column) -> Column:
    """Stored score text as a number; N/A and blank give null."""
    return text.try_cast("double")


def reports(cases: DataFrame) -> DataFrame:
    """cases with score texts and evidence_json -> one report struct per case."""
    d = cases.withColumn("_e", parsed_evidence(F.col("evidence_json")))
    e = F.col("_e")
    summary = F.struct(*[evidence_value(e, p).alias(n) for n, p in EVIDENCE_SUMMARY.items()])
    reasons = F.coalesce(evidence_value(e, "$.decision_engine.decision_reasons", "array<string>"),
                         F.array().cast("array<string>"))
    return d.withColumn("report", F.struct(
        F.lit("SCREENING_SUMMARY").alias("report_type"), "case_id", "document_type", "decision",
        number(F.col("authenticity_estimate")).alias("authenticity_estimate"),
        number(F.col("confidence")).alias("confidence"),
        number(F.col("evidence_quality")).alias("evidence_quality"),
        summary.alias("evidence_summary"), reasons.alias("reasons"),
        evidence_value(e, "$.decision_engine.recommended_action").alias("recommended_action"),
        F.lit(DISCLAIMER).alias("disclaimer"), F.lit(BANNER).alias("demo_banner"),
    )).drop("_e")


def markdown(report: Column) -> Column:
    """Markdown text of a report struct."""

    def s(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), s(value))

    es = report["evidence_summary"]
    reasons = F.array_join(F.transform(report["reasons"], lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws(
        "\n", line("# Screening Report — ", report["case_id"]), F.lit(""),
        line("**Document type:** ", report["document_type"]), line("**Decision:** ", report["decision"]),
        line("**Authenticity estimate (proxy):** ", report["authenticity_estimate"]),
        line("**Confidence:** ", report["confidence"]),
        line("**Evidence quality:** ", report["evidence_quality"]), F.lit(""), F.lit("## Evidence summary"),
        line("- OCR: ", es["ocr_status"]), line("- MRZ: ", es["mrz_status"]),
        line("- Fusion: ", es["fusion_status"]), line("- Tampering: ", es["tampering_severity"]),
        line("- Face: ", es["face_status"]), line("- Cross-validation: ", es["cross_validation"]),
        line("- Calibration: ", es["calibration"]), F.lit(""), F.lit("## Reasons"),
        F.when(F.size(report["reasons"]) > 0, reasons), F.lit(""),
        F.concat(F.lit("**Recommended action:** "), F.coalesce(report["recommended_action"], F.lit("—"))),
        F.lit(""), F.lit("## Disclaimer"), report["disclaimer"], F.lit(""),
        F.concat(F.lit("*"), report["demo_banner"], F.lit("*")), F.lit(""))


def write_reports(built: DataFrame, path: str, shards: int = 256) -> None:
    """JSON lines and Markdown, in directories spread by a hash of the case."""
    d = built.withColumn("shard", F.pmod(F.xxhash64("case_id"), F.lit(shards)))
    d.select("shard", "case_id", F.to_json("report").alias("value")).write.mode("append").partitionBy(
        "shard").parquet(f"{path}/json")
    d.select("shard", "case_id", markdown(F.col("report")).alias("value")).write.mode("append").partitionBy(
        "shard").parquet(f"{path}/markdown")


def evidence_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))
