"""Tampering review scores, text-region and photo-region cues. Review signals only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, clip01, flags, r, weighted
from idsieve.functions.fixed import TAMPER_THRESHOLDS, TAMPER_WEIGHTS
from idsieve.operators.ordered import top_k_per_key


# --- whole-image signals -------------------------------------------------------

def ela_score(mean_residual: Column, max_z: Column) -> Column:
    return clip01(0.55 * (mean_residual / 25.0) + 0.45 * (max_z / 6.0))


def local_anomaly(max_z: Column) -> Column:
    return clip01(max_z / 6.0)


def tamper_flags(d: DataFrame) -> DataFrame:
    return d.withColumn("flags", flags(
        *[(F.col(k) > limit, k) for k, limit in TAMPER_THRESHOLDS.items()]))


def review(signals: DataFrame) -> DataFrame:
    """Review score, flags and severity from the six signals; missing signals count 0."""
    d = signals.withColumns({k: F.coalesce(F.round(k, 4), F.lit(0.0)) for k in TAMPER_WEIGHTS})
    d = tamper_flags(d.withColumn("_score", clip01(weighted(TAMPER_WEIGHTS))))
    s = F.col("_score")
    return d.withColumns({
        "severity": case((s >= 0.65, "ELEVATED_REVIEW"),
                         ((s >= 0.40) | (F.size("flags") > 0), "MILD_REVIEW"),
                         otherwise="LOW_SIGNAL"),
        "review_score": r(s),
    }).drop("_score")


# --- text regions ---------------------------------------------------------------
# regions: doc_id, box_ord, x, y, w, h, doc_w, doc_h, sharpness, contrast, local_residual, global_residual

REGION_MIN_PX = 2


def usable_regions(regions: DataFrame) -> DataFrame:
    return regions.filter((F.col("w") >= REGION_MIN_PX) & (F.col("h") >= REGION_MIN_PX)).withColumns({
        "relative_height": F.col("h") / F.greatest(F.lit(1), F.col("doc_h")),
        "relative_width": F.col("w") / F.greatest(F.lit(1), F.col("doc_w")),
    })


def visual_regions(candidates: DataFrame, k: int = 24) -> DataFrame:
    """Text-like components: size, aspect and band rules, best ``k`` per page."""
    area, aspect = F.col("area"), F.col("w") / F.greatest(F.lit(1), F.col("h"))
    page = F.col("doc_w") * F.col("doc_h")
    mid = (F.col("y") + F.col("h") / 2) / F.greatest(F.lit(1), F.col("doc_h"))
    ok = (
        (area >= F.greatest(F.lit(40), F.floor(page * 0.00015))) & (area <= F.floor(page * 0.18))
        & (F.col("w") >= 8) & (F.col("h") >= 6) & aspect.between(0.8, 28.0) & mid.between(0.04, 0.96)
    )
    scored = candidates.filter(ok).withColumn("region_score", area * F.least(aspect, F.lit(8.0)))
    return top_k_per_key(scored, ["doc_id"], [F.desc("region_score"), F.asc("box_ord")], k)


def merge_regions(ocr_boxes: DataFrame, visual: DataFrame, enough: int = 4) -> DataFrame:
    """OCR boxes, plus visual regions with a new bbox where a page has fewer than ``enough`` boxes."""
    box = ["doc_id", "x", "y", "w", "h"]
    n = ocr_boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    few = visual.join(n, "doc_id", "left").filter(F.coalesce("_n", F.lit(0)) < enough)
    extra = few.join(ocr_boxes.select(*box).distinct(), box, "left_anti").withColumn(
        "region_source", F.when(F.col("_n").isNull(), F.lit("visual_region_fallback"))
        .otherwise(F.lit("ocr+visual"))).drop("_n")
    added = extra.select("doc_id").distinct().withColumn("_added", F.lit(True))
    main = ocr_boxes.join(added, "doc_id", "left").withColumn(
        "region_source", F.when(F.col("_added"), F.lit("ocr+visual")).otherwise(F.lit("ocr"))).drop("_added")
    return main.unionByName(extra, allowMissingColumns=True)


def height_bands(regions: DataFrame) -> DataFrame:
    """Median and MAD of relative heights. Equal heights are counted first, so one large
    document shrinks to its distinct heights before its percentile is taken."""
    counts = regions.groupBy("doc_id", "relative_height").agg(F.count(F.lit(1)).alias("_n"))
    med = counts.groupBy("doc_id").agg(
        F.percentile("relative_height", 0.5, F.col("_n")).alias("median_height"), F.sum("_n").alias("region_count"))
    dev = counts.join(med, "doc_id").withColumn("_dev", F.abs(F.col("relative_height") - F.col("median_height")))
    mad = dev.groupBy("doc_id").agg((F.percentile("_dev", 0.5, F.col("_n")) + 1e-9).alias("mad"))
    return med.join(mad, "doc_id")


def height_outliers(regions: DataFrame) -> DataFrame:
    """Regions much taller than their page's others; pages of three regions or more."""
    h = r(F.col("relative_height"), 5)
    return regions.join(height_bands(regions), "doc_id").filter(
        (F.col("region_count") >= 3)
        & (F.abs(h - F.col("median_height")) / F.col("mad") > 6.0) & (h > F.col("median_height") * 2.5))


def alignment(regions: DataFrame) -> DataFrame:
    left = F.col("x") / F.greatest(F.lit(1), F.col("doc_w"))
    return regions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("region_count"),
        r(F.stddev_pop(left)).alias("left_alignment_std"),
        r(F.avg("sharpness"), 2).alias("mean_local_sharpness"),
        r(F.avg("contrast"), 2).alias("mean_local_contrast"),
        r(F.avg("relative_width"), 5).alias("mean_relative_width"))


def splice(regions: DataFrame) -> DataFrame:
    """Residual of a region against its page: status and score."""
    ratio = F.col("local_residual") / (F.col("global_residual") + 1e-6)
    d = regions.withColumn("ratio", ratio)
    q = F.col("ratio")
    return d.withColumns({
        "splice_status": case(
            (F.col("w") * F.col("h") < 16, "NO_CLEAR_ANOMALY"),
            ((q > 2.2) | (q < 0.35), "ANOMALY_DETECTED"), ((q > 1.7) | (q < 0.5), "UNCERTAIN"),
            otherwise="NO_CLEAR_ANOMALY"),
        "splice_score": r(F.least(F.lit(1.0), F.abs(F.ln(q + 1e-6)) / 2.0)),
    })


def splice_summary(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per page anomaly count over all regions, flagged rows)."""
    every = splice(regions)
    per_doc = every.groupBy("doc_id").agg(
        F.count_if(F.col("splice_status") == "ANOMALY_DETECTED").alias("anomaly_count"),
        F.count(F.lit(1)).alias("regions_read"))
    return per_doc, every.filter("splice_status <> 'NO_CLEAR_ANOMALY'")


def text_cross(has_box: Column, crop_px: Column, sharpness: Column) -> Column:
    return case(
        (~has_box, "NOT_FOUND"), (F.coalesce(crop_px, F.lit(0)) < 16, "UNCERTAIN"),
        (sharpness > 20, "CONSISTENT"), otherwise="UNCERTAIN")


def cross_check(fields: DataFrame, region_stats: DataFrame) -> DataFrame:
    """Every field against its image region."""
    return fields.join(region_stats, ["doc_id", "field"], "left").withColumn(
        "status", text_cross(F.col("bbox").isNotNull(), F.col("crop_px"), F.col("sharpness")))


# --- photo, stamp, metadata ---------------------------------------------------------

def photo_ring(d: DataFrame) -> DataFrame:
    """face_w, face_h, ring_residual, inner_residual -> photo_status, photo_detection, photo_score."""
    q = (F.col("ring_residual") + 1e-6) / (F.col("inner_residual") + 1e-6)
    no_box, small = F.col("face_w").isNull(), (F.col("face_w") < 8) | (F.col("face_h") < 8)
    return d.withColumn("_q", q).withColumns({
        "photo_status": case((no_box, "NOT_APPLICABLE"), (small, "UNCERTAIN"), otherwise="ANALYZED"),
        "photo_detection": F.when(~no_box & ~small, case(
            ((F.col("_q") > 2.0) | (F.col("_q") < 0.4), "ANOMALY_DETECTED"),
            ((F.col("_q") > 1.6) | (F.col("_q") < 0.55), "UNCERTAIN"), otherwise="NO_CLEAR_ANOMALY")),
        "photo_score": F.when(~no_box & ~small, r(F.least(F.lit(1.0), F.abs(F.ln("_q")) / 2.0))),
    }).drop("_q")


def stamp(circles: Column, ink: Column) -> Column:
    return case(((circles > 0) & (ink > 0.002), "DETECTED"), (ink > 0.01, "UNCERTAIN"),
                otherwise="NO_CLEAR_ANOMALY")


def metadata(tags: Column) -> Column:
    """struct(status, tag_count, tags_sample, suspicious) of an EXIF tag map."""
    n = F.coalesce(F.size(tags), F.lit(0))
    n = F.greatest(n, F.lit(0))
    sample = F.map_from_entries(F.array_sort(F.map_entries(tags)))
    return F.struct(
        F.when(n > 0, F.lit("PRESENT")).otherwise(F.lit("UNAVAILABLE")).alias("status"),
        n.alias("tag_count"), sample.alias("tags_sample"), F.lit(False).alias("suspicious"))


def forensic_map(d: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Fold the present result columns into one struct per area (text, image, metadata)."""
    return d.withColumn("forensics", F.struct(*[
        F.struct(*[c for c in cols if c in d.columns]).alias(name) for name, cols in groups.items()
    ]))
