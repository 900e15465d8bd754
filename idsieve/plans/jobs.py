"""Composed jobs: one DataFrame -> DataFrame function per call of the screening service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.operators import (
    audit, cases, cells as oc, classify, decision, evidence, fields as of, forensics as fo,
    identity, intake, models, mrz, ocr, quality, rasters,
)
from idsieve.settings import DEFAULT, Settings
from idsieve.sources.profiles import with_profile


def intake_job(files: DataFrame, settings: Settings = DEFAULT, decoded: DataFrame | None = None,
               key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted metadata, rejected names with code)."""
    v = intake.validate(files, settings, decoded, key)
    return intake.accepted_metadata(v, settings), v.filter("code IS NOT NULL").select(key, "filename", "code")


def quality_job(measured: DataFrame) -> DataFrame:
    return quality.score_map(quality.report(measured))


def classify_job(cues: DataFrame, weights=None, bias=None) -> DataFrame:
    return classify.classify(cues, weights, bias)


def text_job(docs: DataFrame, boxes: DataFrame, today: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with text and MRZ, masked fields, field summary).

    docs(doc_id, document_type), boxes of all passes.
    """
    best = ocr.boxes_of_best_pass(boxes)
    texts = docs.select("doc_id", "document_type").join(ocr.full_text(best).hint("merge"), "doc_id", "left").withColumn(
        "full_text", F.coalesce("full_text", F.lit("")))
    found = of.assess(of.extract(texts, today), best)
    raw = of.raw_values(found, ["name", "date_of_birth", "document_number", "visa_number", "passport_number"])
    visible = raw.select("doc_id", F.col("name").alias("vis_name"), F.col("date_of_birth").alias("vis_dob"),
                         F.coalesce("document_number", "visa_number", "passport_number").alias("vis_number"))
    zone = mrz.analyze(with_profile(texts).select("doc_id", "supports_mrz", "full_text").join(
        visible.hint("merge"), "doc_id", "left"))
    pages = zone.join(ocr.mean_confidence(best).hint("merge"), "doc_id", "left").drop("vis_name", "vis_dob", "vis_number")
    return pages, of.publish(found), of.summarize(docs, found)


def features_job(emb: DataFrame, weights, bias, dim: int, prototypes, keep: int = 12) -> DataFrame:
    """embedding(+category) -> summary, head, prototype alignment, vision status."""
    from idsieve.functions import vectors as v

    d = emb.withColumn("embedding", F.col("embedding").cast("array<double>"))
    d = d.withColumns({"summary": v.summary(F.col("embedding"), keep),
                       "head": models.head(F.col("embedding"), weights, bias, dim)})
    d = models.alignment(models.prototype_scores(d, prototypes))
    have = F.col("embedding").isNotNull()
    return d.withColumn("vision_status", models.vision_status(have, have, have))


def tamper_job(gray: DataFrame, planes: DataFrame | None, tile: int = 32, block: int = 8, grid: int = 24,
               copy_guard: int | None = 48, edge_threshold: float | None = 160.0,
               compression: bool = True, local_tile: int = 48, ela_tile: int | None = None) -> DataFrame:
    """Signals, flags, severity and hotspots from cells. Signals that are switched off or have no
    plane count 0, and their flags are not raised. ELA tiles are by default a twelfth of the
    shorter side, 24 pixels at least."""
    key = ["doc_id", "plane"]
    m = oc.neighbours(gray)
    d = oc.tile_cv(oc.tiles(m, "laplacian", tile, tile), "tile_std", "noise_inconsistency")
    z = oc.tile_max_z(oc.tiles(m, "residual", local_tile, local_tile), "tile_mean", "_z")
    d = d.join(z.select(*key, fo.local_anomaly(F.col("_z")).alias("local_image_anomaly")), key)
    if planes is not None:
        ela = planes.filter(F.col("plane") == "ela")
        size = F.lit(ela_tile) if ela_tile else F.greatest(F.lit(24), F.floor(F.least("img_h", "img_w") / 12))
        z = oc.tile_max_z(oc.tiles(ela, "value", size, size), "tile_mean", "_z")
        mean = ela.groupBy(*key).agg(F.avg("value").alias("_mean"))
        d = d.join(mean.join(z, key).select("doc_id", fo.ela_score(F.col("_mean"), F.col("_z")).alias("ela_inconsistency")),
                   "doc_id", "left")
    if compression:
        d = d.join(oc.tile_cv(oc.tiles(m, "residual", block, 2 * block), "tile_var",
                              "compression_inconsistency"), key)
    if edge_threshold is not None:
        d = d.join(oc.edge_bands(m, edge_threshold).select(*key, "edge_inconsistency"), key)
    if copy_guard is not None:
        d = d.join(oc.block_copies(gray, block, copy_guard), key, "left")
    from idsieve.functions.fixed import HOTSPOT_MIN, TAMPER_WEIGHTS
    d = evidence.with_missing(d, {k: "double" for k in TAMPER_WEIGHTS})
    out = fo.review(d).drop("plane").withColumn("tamper_status", F.lit("ANALYZED"))
    if planes is None:
        return out.withColumn("hotspot_count", F.lit(0).cast("long"))
    size = planes.groupBy("doc_id").agg(F.max("img_h").alias("img_h"), F.max("img_w").alias("img_w"))
    heat = oc.heat_blend(planes).join(size, "doc_id")
    spots = oc.grid(heat, grid, grid).filter(F.col("score") >= HOTSPOT_MIN).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("hotspot_count"))
    return out.join(spots, "doc_id", "left").withColumn("hotspot_count", F.coalesce("hotspot_count", F.lit(0)))


def image_job(images: DataFrame, how: rasters.Raster = rasters.Raster()) -> DataFrame:
    """``tamper_job`` for images that are rows: all six signals, flags, severity, hotspots and heat summary in one pass."""
    return fo.review(rasters.tamper_signals(images, how)).withColumn("tamper_status", F.lit("ANALYZED"))


def text_visual_job(regions: DataFrame) -> DataFrame:
    """Typography and splicing per document."""
    r = fo.usable_regions(regions)
    typo = fo.height_outliers(r).groupBy("doc_id").agg(F.count(F.lit(1)).alias("typography_anomalies"))
    return (
        fo.alignment(r).join(typo, "doc_id", "left").join(fo.splice_summary(r)[0], "doc_id", "left")
        .withColumn("typography_anomalies", F.coalesce("typography_anomalies", F.lit(0)))
        .withColumn("consistency_label", F.when(F.col("typography_anomalies") > 0, F.lit("ANOMALY_SIGNAL"))
                    .when(F.col("region_count") >= 3, F.lit("CONSISTENT")).otherwise(F.lit("INSUFFICIENT_REGIONS"))))


def metadata_job(images: DataFrame) -> DataFrame:
    return images.withColumn("meta", fo.metadata(F.col("tags")))


def stamp_job(colors: DataFrame, circles: DataFrame) -> DataFrame:
    d = oc.ink_fraction(oc.hsv(colors)).join(circles, "doc_id", "left")
    return d.withColumn("detection", fo.stamp(F.coalesce("circles", F.lit(0)), F.col("ink_fraction")))


def photo_job(faces: DataFrame) -> DataFrame:
    return fo.photo_ring(faces)


def faces_job(images: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Status, count and primary face per image. Detection never implies a match."""
    rated = identity.face_quality(faces)
    primary = identity.face_summary(rated, keys).drop("face_count", "face_status")
    return identity.face_counts(images, rated, keys).join(primary, keys, "left").withColumn(
        "ver_result", F.lit("NOT_AVAILABLE"))


def compare_job(doc_faces: DataFrame, live_faces: DataFrame, key: str = "session_id") -> DataFrame:
    return identity.compare_faces(identity.pair_sides(doc_faces, live_faces, key))


def liveness_job(frames: DataFrame) -> DataFrame:
    return identity.pad(frames)


def text_module(docs: DataFrame, boxes: DataFrame, today: Column) -> DataFrame:
    """What text recognition says of a document: OCR state and confidence, fields, dates, machine-readable zone."""
    pages, fields, summary = text_job(docs, boxes, today)
    dates = fields.filter(F.col("field").rlike("date|expiry|issue")).groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct(F.concat(F.lit("date_"), F.col("field")).alias("check"), F.col("status").alias("status")))).alias("date_checks"))
    seen = F.coalesce("text_box_count", F.lit(0)) > 0
    page = pages.select(
        "doc_id", "supports_mrz", "mrz_status", "name_cmp", "dob_cmp", "number_cmp", F.when(seen, "OK").otherwise("NOT_ASSESSED").alias("ocr_status"),
        F.col("mean_ocr_confidence").alias("ocr_confidence"), F.col("check_digits_ok").cast("double").alias("mrz_check_pass_rate"),
        F.col("mrz_status").isin("PARSED", "PARTIAL").cast("double").alias("mrz_parsed"))
    found = summary.select("doc_id", "field_count", "field_completeness", "mean_field_ocr_confidence", "fields_status")
    return page.join(found.hint("merge"), "doc_id", "left").join(dates.hint("merge"), "doc_id", "left")


def face_module(pairs: DataFrame, key: str = "session_id") -> DataFrame:
    """Faces of both sides and their comparison, from ``compare_job``, as the identity verdict reads them."""
    status = lambda n: F.when(F.col(n) == 0, "NOT_DETECTED").when(F.col(n) == 1, "DETECTED").otherwise("MULTIPLE_DETECTED")
    return pairs.select(
        F.col(key).alias("doc_id"), status("doc_count").alias("face_status"), F.col("doc_count").cast("long").alias("face_count"),
        status("doc_count").alias("doc_face_status"), F.when(F.col("live_count") > 0, "CAPTURED").alias("camera_status"),
        F.when(F.col("live_count") > 0, status("live_count")).alias("live_face_status"),
        F.when(F.col("live_count") > 0, F.col("live_count").cast("long")).alias("live_face_count"),
        F.col("cmp_status").alias("ver_status"), F.col("cmp_result").alias("ver_result"), "similarity", "embedding_sources", F.lit(True).alias("expects_photo"))


def liveness_module(frames: DataFrame, key: str) -> DataFrame:
    """The worst capture of a document: one suspect frame counts, whatever the others show."""
    worst = F.when(F.col("pad_decision").startswith("SUSPECT"), 3).when(F.col("pad_decision") == "INCONCLUSIVE", 2).when(
        F.col("pad_decision") == "NOT_APPLICABLE", 0).otherwise(1)
    d = liveness_job(frames)
    return d.groupBy(F.col(key).alias("doc_id")).agg(
        F.max_by(F.struct("pad_status", "pad_decision"), F.struct(worst, "spoof")).alias("w")).select("doc_id", "w.*")


SCREEN_FUSION = (
    "enet_fp", "enet_auth", "enet_tamp", "enet_present", "vit_fp", "vit_auth", "vit_tamp", "vit_present",
    "clip_fp", "clip_proto", "clip_present",
)


def screen_job(docs: DataFrame, modules: list[DataFrame], fusion_weights, fusion_bias,
               platt: tuple[float, float]) -> DataFrame:
    """Whole screening over one row per document.

    The module outputs (quality, type, text, forensics, faces, vectors) are left
    joined on doc_id; fusion, checks, confidence and decision are projections
    after that, so the documents are exchanged once.
    """
    d = evidence.join_evidence(docs, modules)
    d = evidence.with_missing(d, {
        **evidence.PRIOR_COLUMNS, **evidence.CHECK_COLUMNS,
        **{n: "double" for n in SCREEN_FUSION if not n.endswith(("_fp", "_proto"))},
        "enet_fp": "array<double>", "vit_fp": "array<double>", "clip_fp": "array<double>",
        "clip_proto": "array<double>", "mrz_check_pass_rate": "double", "mrz_parsed": "double"})
    d = d.withColumn("doc_type_confidence", F.col("type_confidence"))
    d = models.fuse(d, fusion_weights, fusion_bias).drop("fusion_vector", "doc_type_confidence")
    d = evidence.rollup_in_row(evidence.checks_column(d))
    d = evidence.prior_decision(d)
    d = d.withColumn("quality_ok", ~F.coalesce("insufficient_for_analysis", F.lit(False)))
    d = evidence.confidence(models.calibrate(d, *platt))
    d = decision.decide(d)
    return d.withColumn("reasons", evidence.merge_reasons(F.col("prior_reasons"), F.col("decision_reasons")))


def cases_job(screened: DataFrame) -> DataFrame:
    """Screened documents (with doc_id, submitted_at) as finished case rows."""
    ids = cases.allocate_ids(screened.select("doc_id", "submitted_at")).select("doc_id", "case_id")
    return screened.join(ids, "doc_id")


def audit_job(events: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return audit.verify(events, keys)


def train_job(rows: DataFrame, spark, name: str, **kw) -> DataFrame:
    """Fit one model and return its weights table."""
    return models.weights_table(spark, models.train(rows, **kw), name)
