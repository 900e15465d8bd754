"""Operators over image cells: doc_id, plane, r, c, value.

Cells are the widest table of all. Windows run inside one image row or column,
everything else is a partial aggregation; whole images are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.functions.common import clip, clip01, r
from idsieve.functions.fixed import HEAT_WEIGHTS, HOTSPOT_MAX, HOTSPOT_MIN
from idsieve.operators.ordered import top_k_per_key

KEY = ["doc_id", "plane"]


def _around(w, c: str) -> tuple[Column, Column]:
    """Neighbours before and after; at a border the inner one stands for both (reflect-101)."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))


def neighbours(cells: DataFrame) -> DataFrame:
    """Add laplacian, residual (|value - 3x3 Gaussian|) and gradient."""
    row = Window.partitionBy(*KEY, "r").orderBy("c")
    col = Window.partitionBy(*KEY, "c").orderBy("r")
    left, right = _around(row, "value")
    d = cells.withColumns({"_l": left, "_r": right})
    d = d.withColumn("_h", (F.col("_l") + 2 * F.col("value") + F.col("_r")) / 4)
    up, down = _around(col, "value")
    hu, hd = _around(col, "_h")
    d = d.withColumns({"_u": up, "_d": down, "_hu": hu, "_hd": hd})
    blur = (F.col("_hu") + 2 * F.col("_h") + F.col("_hd")) / 4
    return d.select(
        *cells.columns,
        (F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * F.col("value")).alias("laplacian"),
        F.abs(F.col("value") - blur).alias("residual"),
        (F.abs(F.col("_r") - F.col("_l")) + F.abs(F.col("_d") - F.col("_u"))).alias("gradient"),
    )


def pixel_stats(measured: DataFrame) -> DataFrame:
    """Brightness, contrast, noise and sharpness per image."""
    return measured.groupBy(*KEY).agg(
        F.avg("value").alias("mean_brightness"), F.stddev_pop("value").alias("contrast_std"),
        F.avg("residual").alias("noise_level"), F.var_pop("laplacian").alias("laplacian_variance"),
    )


def tiles(cells: DataFrame, value: str, size: int | Column, step: int | Column) -> DataFrame:
    """Mean and population deviation per tile of ``size`` taken every ``step``.

    Needs img_h and img_w. A tile starts before max(1, side - size), so the
    ragged border is left out.
    """
    tr, tc = (F.col("r") / step).cast("int"), (F.col("c") / step).cast("int")
    inside = (
        (F.col("r") % step < size) & (F.col("c") % step < size)
        & (tr * step < F.greatest(F.lit(1), F.col("img_h") - size))
        & (tc * step < F.greatest(F.lit(1), F.col("img_w") - size))
    )
    return (
        cells.filter(inside).groupBy(*KEY, tr.alias("tile_r"), tc.alias("tile_c"))
        .agg(F.avg(value).alias("tile_mean"), F.stddev_pop(value).alias("tile_std"),
             F.var_pop(value).alias("tile_var"))
    )


def tile_cv(tile_rows: DataFrame, stat: str, alias: str) -> DataFrame:
    """clip(std / mean / 5) of a tile statistic per image."""
    cv = F.stddev_pop(stat) / (F.avg(stat) + 1e-6)
    return tile_rows.groupBy(*KEY).agg(clip01(cv / 5).alias(alias))


def tile_max_z(tile_rows: DataFrame, stat: str, alias: str) -> DataFrame:
    """(max - mean) / std of a tile statistic; 0 for a flat image."""
    sd = F.stddev_pop(stat)
    z = F.when(sd > 1e-6, (F.max(stat) - F.avg(stat)) / (sd + 1e-6)).otherwise(0.0)
    return tile_rows.groupBy(*KEY).agg(z.alias(alias))


def edge_bands(measured: DataFrame, threshold: float) -> DataFrame:
    """Edge energy (0 or 255) per band, side variances, photo bias, edge imbalance."""
    h, w = F.col("img_h"), F.col("img_w")
    edge = F.when(F.col("gradient") > threshold, 255.0).otherwise(0.0)

    def third(n: int, of: Column, parts: int) -> Column:
        return F.floor(of * n / parts)

    def mean(cond: Column, x: Column) -> Column:
        return F.avg(F.when(cond, x))

    row, col = F.col("r"), F.col("c")
    on = (edge > 0).cast("double")
    left_var = F.var_pop(F.when(col < third(1, w, 3), F.col("value")))
    right_var = F.var_pop(F.when(col >= third(2, w, 3), F.col("value")))
    agg = measured.groupBy(*KEY).agg(
        mean(row < F.greatest(F.lit(1), third(1, h, 5)), edge).alias("top_edge"),
        mean((row >= third(1, h, 3)) & (row < third(2, h, 3)), edge).alias("mid_edge"),
        mean(row >= third(4, h, 5), edge).alias("bottom_edge"),
        left_var.alias("left_var"), right_var.alias("right_var"),
        mean(row < F.greatest(F.lit(1), third(1, h, 3)), on).alias("_top"),
        mean(row >= third(2, h, 3), on).alias("_bottom"),
    )
    lv, rv = F.coalesce("left_var", F.lit(0.0)), F.coalesce("right_var", F.lit(0.0))
    return agg.withColumns({
        "photo_left_bias": clip((rv - lv) / (rv + lv + 1e-6), -1.0, 1.0),
        "edge_inconsistency": clip01(F.abs(F.col("_top") - F.col("_bottom")) * 4.0),
    }).drop("_top", "_bottom")


def blockiness(cells: DataFrame, block: int = 8) -> DataFrame:
    """Mean step across block borders over mean step inside blocks.

    Steps are averaged per grid line first, then over the lines of both
    directions. Needs img_h and img_w.
    """
    h = F.col("img_h") - F.col("img_h") % block
    w = F.col("img_w") - F.col("img_w") % block
    keyed = cells.withColumns({"_h": h, "_w": w}).filter((F.col("r") < F.col("_h")) & (F.col("c") < F.col("_w")))
    out = []
    for axis, other, size in (("c", "r", "_w"), ("r", "c", "_h")):
        win = Window.partitionBy(*KEY, other).orderBy(axis)
        at = F.col(axis)
        line = F.when((at % block == 0) & (at >= block), F.lit("border")).when(
            (at % block == 2) & (at > block) & (at + 1 < F.col(size)), F.lit("inside"))
        out.append(
            keyed.withColumn("_step", F.abs(F.col("value") - F.lag("value").over(win)))
            .withColumn("_kind", line).filter("_kind IS NOT NULL")
            .groupBy(*KEY, F.lit(axis).alias("axis"), "_kind", at.alias("at"))
            .agg(F.avg("_step").alias("_line"))
        )
    return out[0].unionByName(out[1]).groupBy(*KEY).agg(
        (F.coalesce(F.avg(F.when(F.col("_kind") == "border", F.col("_line"))), F.lit(0.0))
         / (F.coalesce(F.avg(F.when(F.col("_kind") == "inside", F.col("_line"))), F.lit(1.0)) + 1e-6))
        .alias("blockiness"))


def percentile_norm(cells: DataFrame, value: str = "value", out: str = "norm") -> DataFrame:
    """Scale each image's values by its 5th to 95th percentile, clipped; flat images give 0.

    Equal values are counted first, so the exact percentile reads distinct
    values only and one large image stays spread until then.
    """
    counts = cells.groupBy(*KEY, value).agg(F.count(F.lit(1)).alias("_n"))
    band = counts.groupBy(*KEY).agg(
        F.percentile(value, [0.05, 0.95], F.col("_n")).alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    scaled = F.when(hi - lo < 1e-6, 0.0).otherwise(
        clip((F.col(value) - lo) / (hi - lo + 1e-6), 0.0, 1.0))
    return cells.join(band, KEY).withColumn(out, scaled).drop("_p")


def heat_blend(planes: DataFrame) -> DataFrame:
    """Blend the normalised ela, hf and noise planes and normalise again (plane ``heat``)."""
    norm = percentile_norm(planes)
    weight = F.coalesce(*[F.when(F.col("plane") == p, F.lit(w)) for p, w in HEAT_WEIGHTS.items()])
    mixed = norm.groupBy("doc_id", "r", "c").agg(F.sum(weight * F.col("norm")).alias("value"))
    return percentile_norm(mixed.withColumn("plane", F.lit("heat")), out="score")


def grid(heat: DataFrame, rows: int = 24, cols: int = 24) -> DataFrame:
    """Mean score per grid cell; needs img_h and img_w. Cells without pixels are absent."""
    gr = F.floor(((F.col("r") + 1) * rows - 1) / F.col("img_h")).cast("int")
    gc = F.floor(((F.col("c") + 1) * cols - 1) / F.col("img_w")).cast("int")
    return heat.groupBy("doc_id", gr.alias("grid_row"), gc.alias("grid_col")).agg(
        r(F.avg("score")).alias("score"), F.first("img_h").alias("img_h"),
        F.first("img_w").alias("img_w"))


def heat_summary(heat: DataFrame) -> DataFrame:
    return heat.groupBy("doc_id").agg(
        r(clip01(F.max("score"))).alias("peak_score"), r(clip01(F.avg("score"))).alias("mean_score"),
        r(F.avg((F.col("score") >= HOTSPOT_MIN).cast("double"))).alias("high_anomaly_coverage"))


def hotspots(cells: DataFrame, rows: int = 24, cols: int = 24) -> DataFrame:
    """Strongest grid cells as pixel boxes, at most eight per document."""
    best = top_k_per_key(
        cells.filter(F.col("score") >= HOTSPOT_MIN), ["doc_id"],
        [F.desc("score"), F.desc("grid_row"), F.desc("grid_col")], HOTSPOT_MAX)

    def px(i: str, side: str, n: int) -> Column:
        return F.floor(F.col(i) * F.col(side) / n).cast("int")

    return best.select(
        "doc_id", "rank", "grid_row", "grid_col", "score",
        px("grid_col", "img_w", cols).alias("x"), px("grid_row", "img_h", rows).alias("y"),
        F.greatest(F.lit(1), F.floor(F.col("img_w") / cols)).cast("int").alias("w"),
        F.greatest(F.lit(1), F.floor(F.col("img_h") / rows)).cast("int").alias("h"))


def hsv(cells: DataFrame) -> DataFrame:
    """Add h (0-179), s and v (0-255), whole numbers as in 8-bit images, from blue, green and red."""
    b, g, red = F.col("blue"), F.col("green"), F.col("red")
    d = cells.withColumns({"v": F.greatest(b, g, red), "_d": F.greatest(b, g, red) - F.least(b, g, red)})
    v, span = F.col("v"), F.col("_d")
    deg = (F.when(span == 0, 0.0).when(v == red, 60 * (g - b) / span)
           .when(v == g, 120 + 60 * (b - red) / span).otherwise(240 + 60 * (red - g) / span))
    return d.withColumns({
        "s": F.when(v == 0, 0.0).otherwise(F.floor(255 * span / v + 0.5)).cast("double"),
        "_h": F.floor(deg / 2 + 0.5).cast("double"),
    }).withColumn("h", F.when(F.col("_h") < 0, F.col("_h") + 180).otherwise(F.col("_h"))).drop("_d", "_h")


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def color_fractions(colored: DataFrame) -> DataFrame:
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    return colored.groupBy("doc_id").agg(
        _share((h > 90) & (h < 130) & (s > 40)).alias("blue_frac"),
        _share(((h < 35) | (h > 150)) & (s > 20) & (v > 120)).alias("warm_frac"),
        _share((h > 75) & (h < 100) & (s > 30)).alias("cyan_frac"),
        _share((h > 35) & (h < 85) & (s > 40)).alias("green_frac"),
        F.avg("s").alias("mean_saturation"), F.avg("v").alias("mean_value"))


def ink_fraction(colored: DataFrame) -> DataFrame:
    """Share of red or blue ink, as used for stamps."""
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    red = ((h <= 10) | (h >= 170)) & (s >= 70) & (v >= 50)
    blue = h.between(90, 130) & (s >= 60) & (v >= 40)
    return colored.groupBy("doc_id").agg(_share(red | blue).alias("ink_fraction"))


def block_copies(cells: DataFrame, block: int = 8, guard: int = 48, levels: float = 8.0) -> DataFrame:
    """Is a block repeated elsewhere in its image; how alike are the farthest copies.

    Blocks with the same pattern (offsets from their mean in steps of
    ``levels``) are copies. Two copies at least ``guard`` pixels apart exist
    exactly when the outermost copies along rows or columns are that far apart,
    so each pattern needs its four outermost blocks and no pairs at all.
    """
    br, bc = F.floor(F.col("r") / block), F.floor(F.col("c") / block)
    # A block holds block x block values: the collected group is of fixed size.
    b = cells.groupBy(*KEY, br.alias("br"), bc.alias("bc")).agg(
        F.array_sort(F.collect_list(F.struct("r", "c", "value"))).alias("_v"), F.avg("value").alias("_m"),
        F.stddev_pop("value").alias("_sd"))
    b = b.filter((F.size("_v") == block * block) & (F.col("_sd") > 1e-6)).withColumn(
        "_v", F.transform("_v", lambda x: x["value"]))
    sig = F.xxhash64(F.transform("_v", lambda x: F.round((x - F.col("_m")) / levels).cast("int")))
    at = F.struct("br", "bc", "_v", "_m", "_sd")
    ends = b.groupBy(*KEY, sig.alias("_sig")).agg(
        F.min_by(at, F.struct("br", "bc")).alias("_a"), F.max_by(at, F.struct("br", "bc")).alias("_b"),
        F.min_by(at, F.struct("bc", "br")).alias("_c"), F.max_by(at, F.struct("bc", "br")).alias("_d"),
        F.count(F.lit(1)).alias("copies"))

    def pair(p: str, q: str) -> Column:
        x, y = F.col(p), F.col(q)
        far = F.greatest(F.abs(x["br"] - y["br"]), F.abs(x["bc"] - y["bc"])) * block >= guard
        dot = F.aggregate(F.zip_with(x["_v"], y["_v"], lambda s, t: (s - x["_m"]) * (t - y["_m"])),
                          F.lit(0.0), lambda a, e: a + e)
        return F.when(far, dot / (block * block * x["_sd"] * y["_sd"]))

    return ends.filter("copies > 1").groupBy(*KEY).agg(
        clip01(F.max(F.greatest(pair("_a", "_b"), pair("_c", "_d")))).alias("copy_move_indicators"))
