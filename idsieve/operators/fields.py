"""Fields of documents: extraction, confidence, masking, inventory, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, fence, let, r
from idsieve.functions.dates import date_order_checks, parse_date, validate_date
from idsieve.functions.fields import (
    document_number, expects, field_status, match, number_shape, person, reconcile, sex_code,
    source_region,
)
from idsieve.functions.fixed import NATIONALITY_STOP_WORDS, NON_OCR_FIELDS
from idsieve.functions.text import mask_value
from idsieve.operators.ocr import locate_fields
from idsieve.operators.ordered import first_per_key
from idsieve.sources.profiles import with_profile


CHECKS = "struct<status:string,parsed_iso:string,flags:array<string>,note:string>"
FIELD_TYPE = (
    "array<struct<ord:int,field:string,value:string,raw_value:string,validation:string,"
    f"date_checks:{CHECKS}>>"
)


def _captures(docs: DataFrame, compat: bool) -> DataFrame:
    """One column per capture. Each pattern runs once per document, and only for its types."""
    t, text = F.col("document_type"), F.col("full_text")

    def only(cond: Column, c: Column) -> Column:
        return F.when(cond, c)

    def who(name: str) -> Column:
        return person(match(text, name), compat)

    passport, visa = t == "PASSPORT", t == "VISA"
    return docs.withColumns({
        "_surname": only(passport, who("surname")), "_given": only(passport, who("given_names")),
        "_label_name": who("name_label"), "_number": document_number(t, text),
        "_visa_no": only(visa, match(text, "visa_number")),
        "_father": only(expects(t, "father_name"), who("father_name")),
        "_dob_label": match(text, "dob_label"),
        "_issue": match(text, "issue"), "_expiry": match(text, "expiry"),
        "_nat": only(expects(t, "nationality"), match(text, "nationality")),
        "_sex": only(expects(t, "sex") | expects(t, "gender"),
                     let(match(text, "sex"), lambda m: sex_code(m, t))),
        "_address": only(expects(t, "address"), match(text, "address")),
        "_visa_type": only(visa, match(text, "visa_type")),
        "_entries": only(visa, match(text, "entries")),
        "_stay": only(visa, match(text, "duration")),
        "_permit": only(t == "PERMIT", match(text, "permit_type")),
    }).withColumns({
        "_name": F.when(passport, F.coalesce(
            F.concat("_surname", F.lit(" "), "_given"), "_given", "_surname", who("name_colon"),
            "_label_name")).otherwise(F.col("_label_name")),
        "_dob": F.coalesce("_dob_label", only(expects(t, "date_of_birth"), match(text, "date"))),
    })


def extract(docs: DataFrame, today: Column, compat: bool = False) -> DataFrame:
    """docs(doc_id, document_type, full_text) -> one row per field found (raw, internal).

    ``compat`` keeps person names that run on into the next label.
    """
    t = F.col("document_type")
    passport = t == "PASSPORT"
    dates = {"date_of_birth": "_dob", "issue_date": "_issue", "expiry_date": "_expiry"}
    d = _captures(docs.select("doc_id", "document_type", "full_text"), compat)
    d = d.withColumns({c + "_chk": validate_date(F.lit(f), F.col(c), today) for f, c in dates.items()})
    d = d.withColumns({
        "_plain_no": F.when(F.col("_visa_no").isNull(), F.col("_number")),
        "_passport_no": F.when(passport, F.col("_number")),
    })
    out: list[Column] = []

    def add(name: str, value: str | Column, validation: str | Column, raw: str | None = None,
            checks: Column | None = None) -> None:
        v = F.col(value) if isinstance(value, str) else value
        out.append(F.when(v.isNotNull(), F.struct(
            F.lit(len(out) + 1).alias("ord"), F.lit(name).alias("field"), v.alias("value"),
            (F.col(raw) if raw else v).alias("raw_value"),
            (validation if isinstance(validation, Column) else F.lit(validation)).alias("validation"),
            (F.lit(None).cast(CHECKS) if checks is None else checks).alias("date_checks"),
        )))

    def add_date(name: str, weak: Column | None = None) -> None:
        raw = dates[name]
        chk = F.col(raw + "_chk")
        status = chk["status"]
        if weak is not None:
            status = F.when(weak & (status == "PASS"), F.lit("WARNING")).otherwise(status)
        shown = F.when(passport, F.coalesce(chk["parsed_iso"], F.col(raw))).otherwise(F.col(raw))
        add(name, shown, status, raw, F.when(~passport, chk))

    def sex_shape(strict: bool) -> Column:
        known = F.col("_sex").isin("M", "F")
        return F.when(known if strict else F.lit(True), F.lit("PASS")).otherwise(F.lit("WARNING"))

    add("name", "_name", "PASS")
    add("document_number", "_plain_no", number_shape(t, F.col("_plain_no")))
    add("passport_number", "_passport_no", number_shape(t, F.col("_passport_no")))
    add("visa_number", "_visa_no", number_shape(F.lit("VISA"), F.col("_visa_no")))
    add("father_name", "_father", "PASS")
    add_date("date_of_birth", F.col("_dob_label").isNull() & ~passport)
    add_date("issue_date")
    add_date("expiry_date")
    add("nationality", case(
        (passport, F.left(F.upper("_nat"), F.lit(20))),
        (~F.lower("_nat").isin(*NATIONALITY_STOP_WORDS), F.col("_nat"))), "PASS")
    add("sex", F.when(expects(t, "sex"), F.col("_sex")), sex_shape(strict=False))
    add("gender", F.when(expects(t, "gender"), F.col("_sex")), sex_shape(strict=True))
    add("address", "_address", "WARNING")
    add("visa_type", "_visa_type", "PASS")
    add("entries", "_entries", "PASS")
    add("duration_of_stay", "_stay", "PASS")
    add("permit_type", F.when(F.length("_permit") >= 3, F.col("_permit")), "WARNING")
    # Without the fence, the filter that inline implies would run the whole extraction a second time.
    found = fence(F.array_compact(F.array(*out)).cast(FIELD_TYPE))
    return d.select("doc_id", "document_type", found.alias("_found")).select(
        "doc_id", "document_type", F.inline("_found"))


def first_of_each(fields: DataFrame) -> DataFrame:
    """Several extractors may emit one field: the lowest ``ord`` wins."""
    return first_per_key(fields, ["doc_id", "field"], F.col("ord"))


def assess(fields: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add confidence, box and status, and settle the validation with the confidence."""
    return (
        locate_fields(fields, boxes)
        .withColumn("validation", reconcile(F.col("ocr_confidence"), F.col("validation")))
        .withColumn("status", field_status(F.col("ocr_confidence"), F.col("validation")))
        .withColumn("source_region", source_region(F.col("bbox")))
    )


def publish(fields: DataFrame) -> DataFrame:
    """Masked view: raw values never leave."""
    return fields.withColumn("value", mask_value(F.col("field"), F.col("value"))).drop("raw_value")


def applicable(expected: Column) -> Column:
    return F.array_except(expected, F.array(*[F.lit(f) for f in NON_OCR_FIELDS]))


def with_aliases(found: Column) -> Column:
    """sex and gender credit each other; a visa number credits the document number."""
    def when_has(have: str, credit: str) -> Column:
        return F.when(F.array_contains(found, have), F.array(F.lit(credit))).otherwise(
            F.array().cast("array<string>"))

    return F.array_union(F.array_union(found, when_has("sex", "gender")), F.array_union(
        when_has("gender", "sex"), when_has("visa_number", "document_number")))


def summarize(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Completeness, missing fields, counts and status per document.

    Field names come from a short fixed list, so the collected sets are bounded.
    """
    empty = F.array().cast("array<string>")
    per_doc = fields.groupBy("doc_id").agg(
        F.collect_set("field").alias("_found"),
        F.collect_set(F.when(F.col("status") == "EXTRACTED", F.col("field"))).alias("_ok"),
        F.count(F.lit(1)).alias("field_count"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain_count"),
        r(F.avg("ocr_confidence")).alias("mean_field_ocr_confidence"),
        *[F.count_if(F.col("validation") == v).alias(n) for v, n in
          (("PASS", "pass_count"), ("WARNING", "warn_count"), ("FAIL", "fail_count"))],
    )
    need = applicable(F.col("expected_fields"))
    counts = ["field_count", "uncertain_count", "pass_count", "warn_count", "fail_count"]
    base = (
        with_profile(docs.select("doc_id", "document_type")).join(per_doc.hint("merge"), "doc_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("_found", with_aliases(F.coalesce("_found", empty)))
        .withColumn("_ok", with_aliases(F.coalesce("_ok", empty)))
        .withColumn("applicable_count", F.size(need))
        .withColumn("extracted_count", F.size(F.array_intersect(need, F.col("_ok"))))
        .withColumn("missing_expected_fields", F.array_except(need, F.col("_found")))
    )
    done = F.coalesce(
        F.try_divide(F.col("extracted_count"), F.col("applicable_count")), F.lit(0.0))
    return base.select(
        "doc_id", "document_type", *counts, "applicable_count", "extracted_count",
        "missing_expected_fields", "mean_field_ocr_confidence",
        F.round(done, 4).alias("field_completeness"),
    ).withColumn("fields_status", case(
        (F.col("field_count") == 0, "NO_FIELDS"),
        ((F.col("field_completeness") >= 0.6) & (F.col("uncertain_count") == 0), "OK"),
        otherwise="PARTIAL",
    ))


def inventory(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Every expected field with its status: found, MISSING, or NOT_APPLICABLE for visual ones."""
    expected = with_profile(docs.select("doc_id", "document_type")).select(
        "doc_id", F.explode("expected_fields").alias("field"))
    found = fields.select("doc_id", "field", "status", "value", "ocr_confidence", "validation")
    visual = F.col("field").isin(*NON_OCR_FIELDS)
    joined = expected.join(found.hint("merge"), ["doc_id", "field"], "left")
    return joined.withColumn("status", case(
        (visual, "NOT_APPLICABLE"), (F.col("status").isNull(), "MISSING"),
        otherwise=F.col("status"),
    ))


def raw_values(fields: DataFrame, names: list[str]) -> DataFrame:
    """Pivot of raw values, one column per name (internal)."""
    return fields.groupBy("doc_id").agg(*[
        F.max(F.when(F.col("field") == n, F.col("raw_value"))).alias(n) for n in names
    ])


def date_order(raw: DataFrame) -> DataFrame:
    """raw(doc_id, date_of_birth, issue_date, expiry_date) -> rows (doc_id, check, status)."""
    names = ("date_of_birth", "issue_date", "expiry_date")
    parsed = raw.select("doc_id", *[parse_date(F.col(n))["date"].alias(n) for n in names])
    return parsed.select("doc_id", F.inline(date_order_checks(*[F.col(n) for n in names])))
