"""Document type from geometry, colour, layout and file-name cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, fence, let, r
from idsieve.functions.fixed import (
    CLASSIFIER_FEATURES, CORE_TYPES, FILENAME_OTHER_PRIOR, FILENAME_PATTERNS, FILENAME_PRIOR,
)
from idsieve.operators.models import class_probabilities, ranked


# Prior column of each file-name pattern group.
PRIOR_COLUMN = {
    "PAN": "prior_pan", "AADHAAR": "prior_aadhaar", "PASSPORT": "prior_passport",
    "VISA": "prior_visa", "DRIVING_LICENCE": "prior_dl", "PERMIT": "prior_permit",
    "NATIONAL_ID": "prior_national_id",
}


def filename_priors(files: DataFrame, compat: bool = False) -> DataFrame:
    """Prior columns per type group, and prior_other when none matches.

    Names are split on every non-alphanumeric first, so that ``my_visa_scan.png``
    counts; ``compat`` matches the raw name.
    """
    name = F.lower(F.coalesce("filename", F.lit("")))
    d = files.withColumn("_n", name if compat else F.regexp_replace(name, "[^a-z0-9]+", " "))
    d = d.withColumns({
        PRIOR_COLUMN[t]: F.when(F.col("_n").rlike("|".join(pats)), FILENAME_PRIOR).otherwise(0.0)
        for t, pats in FILENAME_PATTERNS.items()
    }).drop("_n")
    none = F.greatest(*PRIOR_COLUMN.values()) == 0
    return d.withColumn("prior_other", F.when(none, FILENAME_OTHER_PRIOR).otherwise(0.0))


def features(d: DataFrame) -> DataFrame:
    """Needs width, height, colour fractions, edge bands, photo_left_bias and priors."""
    lo = F.least("width", "height")
    d = d.withColumn("aspect", F.when(lo <= 0, 1.0).otherwise(F.greatest("width", "height") / lo))
    a = F.col("aspect")
    return d.withColumns({
        "card_like": F.exp(-((a - 1.586) * (a - 1.586)) / (2 * 0.12 * 0.12)),
        "tall_page": F.exp(-((a - 1.42) * (a - 1.42)) / (2 * 0.18 * 0.18)),
        "mean_sat_n": F.col("mean_saturation") / 255.0, "mean_val_n": F.col("mean_value") / 255.0,
        # An Aadhaar hint is half a hint for the national-id class.
        "prior_national_id": F.greatest(F.col("prior_national_id"), F.col("prior_aadhaar") * 0.5),
    })


def feature_vector(d: DataFrame) -> DataFrame:
    return d.withColumn("features", F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLASSIFIER_FEATURES]))


def heuristic(d: DataFrame) -> DataFrame:
    """Additive scores per core type, floored and normalised: array in CORE_TYPES order."""
    c = F.col
    photo = F.greatest(F.lit(0.0), c("photo_left_bias"))
    green = F.coalesce("green_frac", F.lit(0.0))
    base = {
        "PASSPORT": 0.28 * F.greatest(c("tall_page"), 1.0 - F.abs(c("aspect") - 1.35) / 2)
        + 0.25 * c("blue_frac") + 0.12 * photo
        + F.when(c("bottom_edge") > c("mid_edge") * 1.05, 0.12).otherwise(0.0) + c("prior_passport"),
        "VISA": 0.22 * c("card_like") + 0.18 * green + 0.20 * c("prior_visa") + 0.10 * c("warm_frac")
        + c("prior_visa"),
        "NATIONAL_ID": 0.32 * c("card_like") + 0.18 * c("cyan_frac") + 0.10 * c("warm_frac") + 0.12 * photo
        + 0.15 * F.greatest("prior_national_id", "prior_aadhaar", "prior_pan") + c("prior_national_id"),
        "DRIVING_LICENCE": 0.30 * c("card_like") + 0.12 * c("blue_frac") + 0.12 * photo
        + 0.25 * c("prior_dl") + c("prior_dl"),
        "PERMIT": 0.20 * c("card_like") + 0.15 * c("warm_frac") + 0.30 * c("prior_permit")
        + c("prior_permit"),
        "OTHER": F.lit(0.12), "UNKNOWN": F.lit(0.08),
    }
    raw = F.array(*[F.greatest(base[t] + 0.05, F.lit(1e-6)) for t in CORE_TYPES])
    return d.withColumn("heuristic", normalized(raw))


def normalized(a: Column) -> Column:
    return let(a, lambda x: let(F.aggregate(x, F.lit(0.0), lambda s, y: s + y),
                                lambda t: F.transform(x, lambda y: y / t)))


def blend(d: DataFrame, weights=None, bias=None) -> DataFrame:
    """0.55 model + 0.45 heuristic when a model is given, else the heuristic alone."""
    if weights is None:
        return d.withColumn("type_probabilities", F.col("heuristic"))
    d = d.withColumn("_ml", class_probabilities(F.col("features"), weights, bias))
    mixed = F.zip_with("_ml", "heuristic", lambda m, h: 0.55 * m + 0.45 * h)
    return d.withColumn("type_probabilities", normalized(mixed)).drop("_ml")


def gate(d: DataFrame) -> DataFrame:
    """Rank, keep up to three alternatives, and fall back to UNKNOWN when unsure."""
    labels = F.array(*[F.lit(t) for t in CORE_TYPES])

    def settle(rank: Column) -> Column:
        p, margin = rank[0]["probability"], rank[0]["probability"] - rank[1]["probability"]
        unsure = (p < 0.28) | ((margin < 0.05) & (p < 0.4))
        return F.struct(
            F.when(unsure, F.lit("UNKNOWN")).otherwise(rank[0]["label"]).alias("core_type"),
            r(F.when(unsure, F.least(p, F.lit(0.4))).otherwise(p)).alias("type_confidence"),
            margin.alias("margin"),
            F.transform(F.filter(F.slice(rank, 2, 3), lambda x: x["probability"] > 0.04),
                        lambda x: F.struct(x["label"].alias("label"), r(x["probability"]).alias("confidence"))
                        ).alias("alternatives"))

    d = d.withColumn("_g", let(ranked(F.col("type_probabilities"), labels), settle))
    # The fence keeps a filter on the type from ranking every document anew for each use of the rank in it.
    return d.withColumns({"core_type": fence(F.col("_g.core_type")), **{c: F.col(f"_g.{c}") for c in (
        "type_confidence", "margin", "alternatives")}}).drop("_g")


def subtype(d: DataFrame) -> DataFrame:
    """A national id becomes PAN or AADHAAR when that score wins and is strong enough."""
    c = F.col
    d = d.withColumns({
        "_pan": c("prior_pan") + 0.15 * c("warm_frac") + 0.1 * F.greatest(F.lit(0.0), -c("photo_left_bias")),
        "_aad": c("prior_aadhaar") + 0.2 * c("cyan_frac") + 0.1 * F.greatest(F.lit(0.0), c("photo_left_bias")),
    })
    return d.withColumn("document_type", case(
        (c("core_type") != "NATIONAL_ID", c("core_type")),
        ((c("_pan") > c("_aad")) & (c("_pan") > 0.25), "PAN"),
        ((c("_aad") > c("_pan")) & (c("_aad") > 0.25), "AADHAAR"),
        otherwise="NATIONAL_ID")).drop("_pan", "_aad")


def classify(d: DataFrame, weights=None, bias=None) -> DataFrame:
    """Cues (with filename) -> document_type, core_type, type_confidence, alternatives."""
    return subtype(gate(blend(heuristic(feature_vector(features(filename_priors(d)))), weights, bias)))
