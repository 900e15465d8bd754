"""Faces, one-to-one comparison, and passive presentation-attack cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case, clip01, flags, r, weighted
from idsieve.functions.fixed import FACE_MATCH_MIN, FACE_NO_MATCH_MAX, PAD_WEIGHTS
from idsieve.functions.vectors import face_cosine, vector_id


def face_quality(d: DataFrame) -> DataFrame:
    """laplacian_variance, mean_gray, std_gray, w, h, img_w, img_h -> face_quality, face_label."""
    area = F.col("w") * F.col("h") / F.greatest(F.lit(1), F.col("img_w") * F.col("img_h"))
    d = d.withColumn("area_fraction", area)
    a = F.col("area_fraction")
    q = clip01(
        0.35 * clip01(F.col("laplacian_variance") / 500.0)
        + 0.25 * clip01(1.0 - F.abs(F.col("mean_gray") - 128.0) / 128.0)
        + 0.20 * clip01(F.col("std_gray") / 64.0) + 0.20 * clip01(a / 0.08))
    d = d.withColumn("face_quality", q)
    return d.withColumn("face_label", case(
        ((F.col("face_quality") >= 0.65) & (a >= 0.02), "GOOD"), (F.col("face_quality") >= 0.40, "FAIR"),
        otherwise="POOR"))


def _face_status(n: Column) -> Column:
    return case((n == 0, "NOT_DETECTED"), (n == 1, "DETECTED"), otherwise="MULTIPLE_DETECTED")


def face_counts(images: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Faces per image with status; images without a face count 0."""
    n = faces.groupBy(*keys).agg(F.count(F.lit(1)).alias("face_count"))
    return images.join(n, keys, "left").withColumn(
        "face_count", F.coalesce("face_count", F.lit(0))).withColumn(
        "face_status", _face_status(F.col("face_count")))


def primary_faces(faces: DataFrame, keys: list[str]) -> DataFrame:
    """Largest face per image (earliest on ties), by partial aggregation."""
    rest = [c for c in faces.columns if c not in keys]
    order = F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("face_ord")).alias("o"))
    return faces.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("primary"), F.count(F.lit(1)).alias("face_count"))


def face_summary(faces: DataFrame, keys: list[str]) -> DataFrame:
    p = primary_faces(faces, keys)
    return p.select(
        *keys, "face_count", _face_status(F.col("face_count")).alias("face_status"),
        (F.col("face_count") == 1).alias("detected"), "primary",
        vector_id(F.col("primary.embedding")).alias("embedding_id"))


def pair_sides(doc_faces: DataFrame, live_faces: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session: primary face and count of both sides (full outer: a side may be absent)."""

    def side(f: DataFrame, name: str) -> DataFrame:
        s = primary_faces(f, [key])
        return s.select(key, F.col("primary").alias(name), F.col("face_count").alias(f"{name}_count"))

    both = side(doc_faces, "doc").join(side(live_faces, "live"), key, "full_outer")
    return both.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("doc_count", "live_count")})


def compare_faces(pairs: DataFrame) -> DataFrame:
    """pairs(doc, doc_count, live, live_count) -> cmp_status, cmp_result, similarity, embedding_sources.

    The sides carry embedding, face_label and image_sha. Equal bytes or an equal
    vector are a self-comparison and never a match.
    """
    d = pairs.withColumns({
        "_single": (F.col("doc_count") == 1) & (F.col("live_count") == 1),
        "_same_bytes": F.col("doc.image_sha") == F.col("live.image_sha"),
        "_same_vector": F.col("doc.embedding") == F.col("live.embedding"),
    })
    d = d.withColumn("_sim", F.when(F.col("_single"), clip01(
        (face_cosine(F.col("doc.embedding"), F.col("live.embedding")) + 1.0) / 2.0)))
    guard = F.col("_same_bytes") | F.col("_same_vector")
    poor = (F.col("doc.face_label") == "POOR") | (F.col("live.face_label") == "POOR")
    none = (F.col("doc_count") == 0) | (F.col("live_count") == 0)
    s = F.col("_sim")
    return d.withColumns({
        "cmp_status": F.when(F.col("_single"), F.lit("COMPARED_UNCALIBRATED")).otherwise(F.lit("NOT_ASSESSED")),
        "cmp_result": case(
            (none, "NOT_AVAILABLE"), (~F.col("_single"), "INCONCLUSIVE"), (guard, "INCONCLUSIVE"),
            ((s >= FACE_MATCH_MIN) & poor, "INCONCLUSIVE"), (s >= FACE_MATCH_MIN, "MATCH"),
            (s <= FACE_NO_MATCH_MAX, "NO_MATCH"), otherwise="INCONCLUSIVE"),
        "similarity": r(s),
        "embedding_sources": F.when(F.col("_single"), case(
            (F.col("_same_bytes"), "SAME_IMAGE_BYTES"), (F.col("_same_vector"), "IDENTICAL_VECTOR"),
            otherwise="DIFFERENT")),
    }).drop("_single", "_same_bytes", "_same_vector", "_sim")


# --- liveness ------------------------------------------------------------------------

def motion(prev: Column, gray: Column) -> Column:
    """Mean absolute difference of two thumbnails / 40; null without a previous one."""
    diff = F.aggregate(F.zip_with(prev, gray, lambda a, b: F.abs(a - b).cast("double")),
                       F.lit(0.0), lambda s, x: s + x)
    return F.when(prev.isNotNull(), clip01(diff / F.size(gray) / 40.0))


def pad(frames: DataFrame) -> DataFrame:
    """Passive cues per frame.

    Input: source, face_count, flat_lap, moire, specular_frac, channel_means,
    area_fraction, motion. ``flat_lap`` is the Laplacian variance of the face crop.
    """
    src = F.when(F.col("source") == "document", F.lit("document")).otherwise(F.lit("live_camera"))
    means = F.col("channel_means")
    n = F.size(means)
    d = frames.withColumns({"source": src, "_bal": F.transform(
        means, lambda x: x / (F.array_max(means) + 1e-6))})
    total = F.aggregate("_bal", F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("_mean", total / n)
    var = F.aggregate(F.transform("_bal", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))),
                      F.lit(0.0), lambda s, x: s + x) / n
    area = F.coalesce("area_fraction", F.lit(0.0))
    d = d.withColumns({
        "flat": clip01(1.0 - clip01(F.col("flat_lap") / 250.0)),
        "moire": clip01(F.col("moire")),
        "specular": clip01(F.col("specular_frac") / 0.08),
        "cast": clip01(F.sqrt(var) / 0.35),
        "static_penalty": F.when(F.col("motion") < 0.02, 0.35).otherwise(0.0),
        "size_penalty": clip01(0.03 / F.greatest(area, F.lit(1e-6)) - 1.0),
    })
    d = d.withColumns({
        "spoof": clip01(weighted(PAD_WEIGHTS)),
        "pad_flags": flags(
            (F.col("flat") >= 0.65, "flat_texture"), (F.col("moire") >= 0.55, "moire_like_energy"),
            (F.col("specular") >= 0.55, "specular_glare"), (F.col("static_penalty") > 0, "low_frame_motion"),
            (area < 0.02, "face_too_small")),
    }).drop("_bal", "_mean")
    is_doc, no_face = F.col("source") == "document", F.coalesce("face_count", F.lit(0)) == 0
    nf = F.size("pad_flags")
    return d.withColumns({
        "pad_status": case((is_doc, "NOT_APPLICABLE"), (no_face, "NOT_ASSESSED"), otherwise="PASSIVE_ASSESSED"),
        "pad_decision": case(
            (is_doc, "NOT_APPLICABLE"), (no_face, "INCONCLUSIVE"),
            ((F.col("spoof") >= 0.62) | (nf >= 3), "SUSPECT_PRESENTATION_ATTACK"),
            ((F.col("spoof") <= 0.35) & (nf == 0), "PASSIVE_OK_UNCALIBRATED"), otherwise="INCONCLUSIVE"),
        "pad_score": F.when(~is_doc & ~no_face, r(F.col("spoof"))),
    })
