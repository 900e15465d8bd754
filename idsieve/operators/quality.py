"""Image quality from measured columns.

Input: doc_id, width, height, laplacian_variance, mean_brightness, contrast_std,
noise_level, skew_degrees, visibility_score, perspective_score, border_activity,
blockiness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, clip01, flags, r, weighted
from idsieve.functions.fixed import QUALITY_MIN, QUALITY_WEIGHTS


def scores(m: DataFrame) -> DataFrame:
    c = F.col
    d = m.withColumns({
        "min_side": F.least("width", "height"),
        "megapixels": c("width") * c("height") / 1_000_000.0,
        "_skew": F.abs("skew_degrees"),
    })
    d = d.withColumns({
        "res_score": clip01(0.45 * (c("min_side") / 900.0) + 0.55 * (c("megapixels") / 1.2)),
        "blur_score": clip01(c("laplacian_variance") / 250.0),
        "brightness_score": clip01(1.0 - F.abs(c("mean_brightness") - 127.0) / 127.0),
        "contrast_score": clip01(c("contrast_std") / 65.0),
        "noise_score": clip01(1.0 - c("noise_level") / 18.0),
        "rotation_score": clip01(1.0 - c("_skew") / 20.0),
        "compression_score": clip01(1.0 - F.greatest(F.lit(0.0), c("blockiness") - 1.0) / 2.5),
    })
    return d.withColumn(
        "lighting_score", clip01(0.6 * c("brightness_score") + 0.4 * c("contrast_score")))


def labels(scored: DataFrame) -> DataFrame:
    c = F.col
    mean, vis = c("mean_brightness"), c("visibility_score")

    def steps(x, good, fair, names=("GOOD", "FAIR", "POOR")):
        return case((x >= good, names[0]), (x >= fair, names[1]), otherwise=names[2])

    def below(x, good, fair, names):
        return case((x <= good, names[0]), (x <= fair, names[1]), otherwise=names[2])

    d = scored.withColumns({
        "resolution": case(
            ((c("min_side") >= 900) & (c("megapixels") >= 0.8), "GOOD"),
            ((c("min_side") >= 500) & (c("megapixels") >= 0.25), "FAIR"), otherwise="POOR"),
        "blur": steps(c("laplacian_variance"), 120, 50, ("LOW", "MEDIUM", "HIGH")),
        "brightness": case((mean.between(70, 185), "GOOD"), (mean.between(45, 210), "FAIR"),
                           otherwise="POOR"),
        "contrast": steps(c("contrast_std"), 45, 25),
        "noise": below(c("noise_level"), 4.5, 9.0, ("LOW", "MEDIUM", "HIGH")),
        "rotation": below(c("_skew"), 3.0, 10.0, ("GOOD", "MILD", "SEVERE")),
        "perspective": steps(c("perspective_score"), 0.75, 0.5),
        "document_visibility": steps(vis, 0.7, 0.4),
        "compression": steps(c("compression_score"), 0.75, 0.45, ("LOW", "MEDIUM", "HIGH")),
        "crop": case((vis < 0.35, "SEVERE"), ((c("border_activity") > 0.22) & (vis < 0.55), "PARTIAL"),
                     otherwise="GOOD"),
    })
    return d.withColumn("crop_score", case(
        (c("crop") == "SEVERE", 0.25), (c("crop") == "PARTIAL", 0.55), otherwise=0.9))


def overall(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("overall_quality", r(clip01(weighted(QUALITY_WEIGHTS))))


def gate(rated: DataFrame) -> DataFrame:
    """Is the image unfit for analysis, and why."""
    c = F.col
    low = c("overall_quality") < QUALITY_MIN
    why = flags(
        (c("blur") == "HIGH", "Image is too blurry for reliable analysis"),
        (c("resolution") == "POOR", "Resolution is too low"),
        (c("brightness") == "POOR", "Brightness is unsuitable"),
        (c("document_visibility") == "POOR", "Document is not clearly visible"),
    )
    d = rated.withColumns({
        "insufficient_for_analysis": low | (c("blur") == "HIGH") | (c("resolution") == "POOR"),
        "_why": why,
    })
    why = F.when(F.size("_why") == 0, F.array(F.lit("Overall evidence quality is insufficient"))
                 ).otherwise(c("_why"))
    text = F.concat(
        F.lit("Image quality is insufficient for reliable verification. "),
        F.array_join(why, "; "), F.lit(". Upload a clearer full-document image."))
    return d.withColumn("reason", F.when(c("insufficient_for_analysis"), text)).drop("_why")


def report(measured: DataFrame) -> DataFrame:
    return gate(overall(labels(scores(measured))))


# Score name and the column it shows, as percentages.
PERCENT = {
    "resolution": "res_score", "sharpness": "blur_score", "lighting": "lighting_score",
    "perspective": "perspective_score", "noise": "noise_score", "rotation": "rotation_score",
    "compression": "compression_score", "visibility": "visibility_score",
    "overall_quality": "overall_quality",
}


def score_map(d: DataFrame) -> DataFrame:
    entries = [x for name, col in PERCENT.items() for x in (F.lit(name), r(F.col(col) * 100, 1))]
    return d.withColumn("scores", F.create_map(*entries))
