"""MRZ analysis per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions import mrz as m
from idsieve.functions.common import case, fence, let
from idsieve.functions.text import mask_value


def select(docs: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``selected``. Text lines decide; windows of the collapsed text only help when the
    lines alone do not parse (``compat`` mixes both from the start)."""
    lines, both = m.line_candidates(F.col("full_text")), m.candidates(F.col("full_text"))
    d = docs.withColumns({"_lines": F.array_distinct(lines), "_both": both})
    d = d.withColumns({"_by_line": m.select_lines(F.col("_lines")),
                       "_by_both": m.select_lines(F.col("_both"))})
    pick = F.col("_by_both") if compat else F.when(
        F.col("_by_line.outcome") == "parsed", F.col("_by_line")).otherwise(F.col("_by_both"))
    return d.withColumn("selected", fence(pick)).drop("_lines", "_both", "_by_line", "_by_both")


def parse(docs: DataFrame, compat: bool = False) -> DataFrame:
    return select(docs, compat).withColumn("parsed", fence(m.parse_selected(F.col("selected"), compat)))


def compare(parsed: DataFrame) -> DataFrame:
    """Add name_cmp, dob_cmp, number_cmp against vis_name, vis_dob, vis_number (raw, internal)."""
    p = F.col("parsed")

    def when_parsed(c: Column) -> Column:
        return F.when(p.isNotNull(), c).otherwise(F.lit("NOT_ASSESSED"))

    return parsed.withColumns({
        "name_cmp": when_parsed(m.compare_name(p["surname"], p["given_names"], F.col("vis_name"))),
        "dob_cmp": when_parsed(m.compare_dob(p["dob"], F.col("vis_dob"))),
        "number_cmp": when_parsed(m.compare_number(p["document_number"], F.col("vis_number"))),
    })


def masked(parsed: DataFrame) -> DataFrame:
    """Replace ``parsed`` by its masked form."""
    p = F.col("parsed")

    def mask(field: str, as_name: str) -> Column:
        return mask_value(F.lit(as_name), p[field]).alias(field)

    hidden = F.struct(
        mask("surname", "name"), mask("given_names", "name"),
        mask("document_number", "document_number"), p["nationality"].alias("nationality"),
        mask("dob", "date_of_birth"), mask("expiry", "expiry_date"),
        p["sex"].alias("sex"), p["issuer"].alias("issuer"),
    )
    return parsed.withColumn("mrz_fields", F.when(p.isNotNull(), hidden))


def analyze(docs: DataFrame, compat: bool = False) -> DataFrame:
    """docs(doc_id, supports_mrz, full_text, vis_*) -> status, structure, digits, checklist, masked fields.

    Documents whose profile has no MRZ skip the text work.
    """
    gated = docs.withColumn("full_text", F.when(F.col("supports_mrz"), F.col("full_text"))
                            .otherwise(F.lit("")))
    d = masked(compare(parse(gated, compat)))
    outcome, p = F.col("selected.outcome"), F.col("parsed")
    status = case(
        (~F.col("supports_mrz"), "NOT_APPLICABLE"), (outcome == "none", "NOT_DETECTED"),
        (outcome == "partial", "PARTIAL"), otherwise="PARSED",
    )
    structure = case((outcome == "parsed", p["structure_valid"]), (outcome == "partial", F.lit(False)),
                     otherwise=F.lit(None).cast("boolean"))
    d = d.withColumns({
        "mrz_status": status,
        "structure_valid": structure,
        "check_digits_ok": F.when(p.isNotNull(), m.all_digits_ok(p)),
    })
    items = m.checklist([
        m.tri(F.col("structure_valid")), m.tri(F.col("check_digits_ok")),
        F.col("name_cmp"), F.col("dob_cmp"), F.col("number_cmp"),
    ])
    not_applicable = F.array(F.struct(
        F.lit("mrz_applicable").alias("item"), F.lit("MRZ applicable").alias("label"),
        F.lit("NOT_APPLICABLE").alias("status")))
    return d.withColumn(
        "checklist", fence(F.when(F.col("supports_mrz"), items).otherwise(not_applicable))
    ).withColumn("structure", F.col("selected.format")).drop("parsed", "selected")


def pass_rate(checklist: Column, mrz_status: Column, check_digits_ok: Column) -> Column:
    """struct(rate, parsed): share of PASS among PASS and FAIL items of a parsed zone."""
    counts = F.struct(
        F.size(F.filter(checklist, lambda c: c["status"] == "PASS")).alias("ok"),
        F.size(F.filter(checklist, lambda c: c["status"].isin("PASS", "FAIL"))).alias("n"),
        F.coalesce(mrz_status == "PARSED", F.lit(False)).alias("parsed"),
        F.coalesce(F.size(checklist) <= 0, F.lit(True)).alias("empty"),
    )
    digits = F.coalesce(check_digits_ok, F.lit(False)).cast("double")
    return let(counts, lambda c: F.struct(
        case((~c["parsed"], 0.0), (c["empty"], digits), (c["n"] > 0, c["ok"] / c["n"]),
             otherwise=0.0).alias("rate"),
        c["parsed"].cast("double").alias("parsed"),
    ))


def from_region(boxes: DataFrame, docs: DataFrame, bands: tuple[float, ...] = (0.68, 0.55)) -> DataFrame:
    """MRZ read from the boxes of the page's bottom bands.

    boxes(doc_id, block_num, line_num, x, y, box_ord, text), docs(doc_id, page_h,
    supports_mrz, vis_*). A parsed zone is named DETECTED here.
    """
    from idsieve.operators.ocr import reading_lines

    page = docs.select("doc_id", "page_h")
    low = boxes.join(page, "doc_id").filter(F.col("y") >= F.floor(F.col("page_h") * min(bands)))
    lines = reading_lines(low.select(boxes.columns)).join(
        low.groupBy("doc_id", "block_num", "line_num").agg(F.min("y").alias("_y"),
                                                           F.first("page_h").alias("_h")),
        ["doc_id", "block_num", "line_num"])
    entry = F.struct("block_num", "line_num", "line_text")
    order = [F.array_sort(F.collect_list(F.when(F.col("_y") >= F.floor(F.col("_h") * b), entry)))
             for b in bands]
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(
        F.concat(*order), lambda t: t["line_text"]), "\n").alias("full_text"))
    joined = docs.drop("full_text").join(text, "doc_id", "left").withColumn(
        "full_text", F.coalesce("full_text", F.lit("")))
    out = analyze(joined)
    return out.withColumn("mrz_status", F.when(F.col("mrz_status") == "PARSED", F.lit("DETECTED"))
                          .otherwise(F.col("mrz_status")))
