"""Quality, cell, tile, heat-map and region queries over embeddings, orders and line items."""

from dataclasses import replace

from pyspark.sql import functions as F

from idsieve.functions.common import r
from idsieve.functions.fixed import QUALITY_WEIGHTS, TAMPER_THRESHOLDS, TAMPER_WEIGHTS
from idsieve.operators import cells as oc, forensics as fo, quality as oq, rasters as ra
from idsieve.queries import inputs as I
from idsieve.queries.registry import query

# --- derived inputs ------------------------------------------------------------------

_CELL = """SELECT vec_id AS doc_id, 'gray' AS plane, CAST(floor(pos / 8) AS INT) AS r, CAST(pos % 8 AS INT) AS c,
 CAST(v AS DOUBLE) * 300 + 128 AS value, 8 AS img_h, 8 AS img_w FROM """
CELLS_SPARK = _CELL + "{embeddings} LATERAL VIEW posexplode(embedding) e AS pos, v"
CELLS_SQL = _CELL + "(SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) e"

_PLANE = """SELECT doc_id, plane, r, c, img_h, img_w,
 CASE plane WHEN 'ela' THEN abs(value - 128) WHEN 'hf' THEN abs(value - 128) * (1 + (r + c) % 3) ELSE abs(value - 100) + r END AS value FROM """
PLANES_SPARK = _PLANE + f"(SELECT doc_id, r, c, value, img_h, img_w, p.plane FROM ({CELLS_SPARK}) x LATERAL VIEW explode(array('ela', 'hf', 'noise')) p AS plane) q"
PLANES_SQL = _PLANE + f"(SELECT doc_id, r, c, value, img_h, img_w, unnest(['ela', 'hf', 'noise']) AS plane FROM ({CELLS_SQL}) x) q"

COLORS = """SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_partkey * 7 % 256 AS DOUBLE) AS blue,
 CAST((l_suppkey * 13 + l_linenumber) % 256 AS DOUBLE) AS green, CAST((l_linenumber * 37 + l_partkey) % 256 AS DOUBLE) AS red FROM {lineitem}"""
COLORS_SQL = I.plain(COLORS)

MEASURES = """SELECT o_orderkey AS doc_id, 300 + o_orderkey % 1400 AS width, 250 + o_orderkey * 7 % 1703 AS height,
 CAST(o_orderkey * 13 % 2999 AS DOUBLE) / 7.0 AS laplacian_variance, CAST(o_orderkey * 17 % 2551 AS DOUBLE) / 10.0 AS mean_brightness,
 CAST(o_orderkey * 19 % 809 AS DOUBLE) / 11.0 AS contrast_std, CAST(o_orderkey * 23 % 1511 AS DOUBLE) / 97.0 AS noise_level,
 CAST(o_orderkey * 29 % 401 AS DOUBLE) / 13.0 - 15 AS skew_degrees, CAST(o_orderkey * 31 % 101 AS DOUBLE) / 101.0 AS visibility_score,
 CAST(o_orderkey * 37 % 103 AS DOUBLE) / 103.0 AS perspective_score, CAST(o_orderkey * 41 % 107 AS DOUBLE) / 107.0 AS border_activity,
 CAST(o_orderkey * 43 % 409 AS DOUBLE) / 109.0 AS blockiness FROM {orders}"""
MEASURES_SQL = I.plain(MEASURES)


def cells(spark, sf):
    return I.derive(spark, sf, CELLS_SPARK)


#: The same images as rows, with the planes as arrays.
_GRAY = "transform(embedding, v -> CAST(v AS DOUBLE) * 300 + 128)"
IMAGES_SPARK = f"""SELECT doc_id, 8 AS img_h, 8 AS img_w, gray, transform(gray, v -> abs(v - 128)) AS ela,
 transform(gray, (v, i) -> abs(v - 128) * (1 + (floor(i / 8) + i % 8) % 3)) AS hf, transform(gray, (v, i) -> abs(v - 100) + floor(i / 8)) AS noise,
 transform(gray, v -> floor(v / 40) * 10.0D) AS flat FROM (SELECT vec_id AS doc_id, {_GRAY} AS gray FROM {{embeddings}}) g"""
SMALL = ra.Raster(tile=2, local_tile=2, ela_tile=2, block=2, grid=4, copy_guard=4, levels=40.0, edge_threshold=90.0)


def images(spark, sf):
    return I.derive(spark, sf, IMAGES_SPARK)


def with_width(arrays, source):
    """The arrays of each image beside its width; images are rows of one table, so this is a projection of it."""
    return ra.cells_of(arrays.withColumn("img_w", F.lit(8)), source)


def c01(x: str) -> str:
    return f"greatest(least({x}, 1.0), 0.0)"


# --- quality --------------------------------------------------------------------------

Q1 = f"""SELECT *, {c01('0.45 * (min_side / 900.0) + 0.55 * (megapixels / 1.2)')} AS res_score, {c01('laplacian_variance / 250.0')} AS blur_score,
 {c01('1 - abs(mean_brightness - 127.0) / 127.0')} AS brightness_score, {c01('contrast_std / 65.0')} AS contrast_score, {c01('1 - noise_level / 18.0')} AS noise_score,
 {c01('1 - abs(skew_degrees) / 20.0')} AS rotation_score, {c01('1 - greatest(0.0, blockiness - 1.0) / 2.5')} AS compression_score
FROM (SELECT *, least(width, height) AS min_side, width * height / 1000000.0 AS megapixels FROM ({MEASURES_SQL}) m) m1"""
Q2 = f"""SELECT *, {c01('0.6 * brightness_score + 0.4 * contrast_score')} AS lighting_score,
 CASE WHEN min_side >= 900 AND megapixels >= 0.8 THEN 'GOOD' WHEN min_side >= 500 AND megapixels >= 0.25 THEN 'FAIR' ELSE 'POOR' END AS resolution,
 CASE WHEN laplacian_variance >= 120 THEN 'LOW' WHEN laplacian_variance >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS blur,
 CASE WHEN mean_brightness BETWEEN 70 AND 185 THEN 'GOOD' WHEN mean_brightness BETWEEN 45 AND 210 THEN 'FAIR' ELSE 'POOR' END AS brightness,
 CASE WHEN contrast_std >= 45 THEN 'GOOD' WHEN contrast_std >= 25 THEN 'FAIR' ELSE 'POOR' END AS contrast,
 CASE WHEN noise_level <= 4.5 THEN 'LOW' WHEN noise_level <= 9 THEN 'MEDIUM' ELSE 'HIGH' END AS noise,
 CASE WHEN abs(skew_degrees) <= 3 THEN 'GOOD' WHEN abs(skew_degrees) <= 10 THEN 'MILD' ELSE 'SEVERE' END AS rotation,
 CASE WHEN perspective_score >= 0.75 THEN 'GOOD' WHEN perspective_score >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS perspective,
 CASE WHEN visibility_score >= 0.7 THEN 'GOOD' WHEN visibility_score >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS document_visibility,
 CASE WHEN compression_score >= 0.75 THEN 'LOW' WHEN compression_score >= 0.45 THEN 'MEDIUM' ELSE 'HIGH' END AS compression,
 CASE WHEN visibility_score < 0.35 THEN 'SEVERE' WHEN border_activity > 0.22 AND visibility_score < 0.55 THEN 'PARTIAL' ELSE 'GOOD' END AS crop
FROM ({Q1}) q1"""
_W = " + ".join(f"{w} * {c}" for c, w in QUALITY_WEIGHTS.items())
Q3 = f"""SELECT *, round({c01(_W)} + 1e-9, 4) AS overall_quality FROM (SELECT *, CASE crop WHEN 'SEVERE' THEN 0.25 WHEN 'PARTIAL' THEN 0.55 ELSE 0.9 END::DOUBLE AS crop_score FROM ({Q2}) q2) q2b"""
Q4 = f"""SELECT *, CASE WHEN bad THEN 'Image quality is insufficient for reliable verification. ' || CASE WHEN why = '' THEN 'Overall evidence quality is insufficient' ELSE why END || '. Upload a clearer full-document image.' ELSE '' END AS reason
FROM (SELECT *, overall_quality < 0.45 OR blur = 'HIGH' OR resolution = 'POOR' AS bad, concat_ws('; ', CASE WHEN blur = 'HIGH' THEN 'Image is too blurry for reliable analysis' END,
 CASE WHEN resolution = 'POOR' THEN 'Resolution is too low' END, CASE WHEN brightness = 'POOR' THEN 'Brightness is unsuitable' END,
 CASE WHEN document_visibility = 'POOR' THEN 'Document is not clearly visible' END) AS why FROM ({Q3}) q3) q3b"""
_S = ["res_score", "blur_score", "brightness_score", "contrast_score", "lighting_score", "noise_score", "rotation_score", "compression_score"]
_L = ["resolution", "blur", "brightness", "contrast", "noise", "rotation", "perspective", "document_visibility", "compression", "crop"]


def measures(spark, sf):
    return I.derive(spark, sf, MEASURES)


@query("q_scores", "SELECT doc_id, " + ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in _S) + f" FROM ({Q2}) q")
def q_scores(spark, sf):
    return oq.scores(measures(spark, sf)).select("doc_id", *[r(F.col(c)).alias(c) for c in _S])


@query("q_labels", f"SELECT doc_id, {', '.join(_L)} FROM ({Q2}) q")
def q_labels(spark, sf):
    return oq.labels(oq.scores(measures(spark, sf))).select("doc_id", *_L)


@query("q_overall", f"SELECT doc_id, overall_quality, round(overall_quality * 100 + 1e-9, 1) AS overall_pct FROM ({Q3}) q")
def q_overall(spark, sf):
    d = oq.score_map(oq.overall(oq.labels(oq.scores(measures(spark, sf)))))
    return d.select("doc_id", "overall_quality", F.col("scores")["overall_quality"].alias("overall_pct"))


@query("q_gate", f"SELECT doc_id, bad AS insufficient_for_analysis, reason FROM ({Q4}) q")
def q_gate(spark, sf):
    return oq.report(measures(spark, sf)).select(
        "doc_id", "insufficient_for_analysis", F.coalesce("reason", F.lit("")).alias("reason"))


@query("job_quality", f"SELECT doc_id, overall_quality, bad AS insufficient_for_analysis, {', '.join(_L)} FROM ({Q4}) q")
def job_quality(spark, sf):
    from idsieve.plans.jobs import quality_job
    return quality_job(measures(spark, sf)).select(
        "doc_id", "overall_quality", "insufficient_for_analysis", *_L)


# --- cells ------------------------------------------------------------------------------

_WR, _WC = "(PARTITION BY doc_id, r ORDER BY c)", "(PARTITION BY doc_id, c ORDER BY r)"
NEIGH = f"""SELECT *, l + rr + u + d - 4 * value AS laplacian, abs(value - (hu + 2 * h + hd) / 4) AS residual, abs(rr - l) + abs(d - u) AS gradient FROM (
 SELECT *, coalesce(lag(value) OVER {_WC}, lead(value) OVER {_WC}) AS u, coalesce(lead(value) OVER {_WC}, lag(value) OVER {_WC}) AS d,
  coalesce(lag(h) OVER {_WC}, lead(h) OVER {_WC}) AS hu, coalesce(lead(h) OVER {_WC}, lag(h) OVER {_WC}) AS hd FROM (
  SELECT *, (l + 2 * value + rr) / 4 AS h FROM (SELECT *, coalesce(lag(value) OVER {_WR}, lead(value) OVER {_WR}) AS l, coalesce(lead(value) OVER {_WR}, lag(value) OVER {_WR}) AS rr FROM ({CELLS_SQL}) c0) c1) c2) c3"""


@query("win_laplacian", f"SELECT doc_id, r, c, round(laplacian, 6) AS laplacian, round(residual, 6) AS residual FROM ({NEIGH}) n")
def q_laplacian(spark, sf):
    return with_width(ra.stencils(images(spark, sf)), ["laplacian", "residual"]).select(
        "doc_id", "r", "c", F.round("laplacian", 6).alias("laplacian"), F.round("residual", 6).alias("residual"))


@query("agg_pixel_stats", f"""SELECT doc_id, round(avg(value), 4) AS mean_brightness, round(stddev_pop(value), 4) AS contrast_std,
 round(avg(residual), 4) AS noise_level, round(var_pop(laplacian), 4) AS laplacian_variance FROM ({NEIGH}) n GROUP BY doc_id""")
def q_pixel_stats(spark, sf):
    return ra.statistics(images(spark, sf), SMALL).select(
        "doc_id", *[F.round(c, 4).alias(c) for c in ("mean_brightness", "contrast_std", "noise_level", "laplacian_variance")])


def tile_sql(src: str, value: str, size: int, step: int) -> str:
    return f"""SELECT doc_id, r // {step} AS tr, c // {step} AS tc, avg({value}) AS tm, stddev_pop({value}) AS ts, var_pop({value}) AS tv FROM ({src}) x
 WHERE r % {step} < {size} AND c % {step} < {size} AND r // {step} * {step} < greatest(1, img_h - {size}) AND c // {step} * {step} < greatest(1, img_w - {size}) GROUP BY ALL"""


@query("agg_tile_stats", f"""SELECT a.doc_id, round({c01('a.cv / 5')}, 6) AS compression_inconsistency, round({c01('b.cv / 5')}, 6) AS noise_inconsistency
FROM (SELECT doc_id, stddev_pop(tv) / (avg(tv) + 1e-6) AS cv FROM ({tile_sql(NEIGH, 'residual', 2, 3)}) t GROUP BY doc_id) a
JOIN (SELECT doc_id, stddev_pop(ts) / (avg(ts) + 1e-6) AS cv FROM ({tile_sql(NEIGH, 'laplacian', 2, 2)}) t GROUP BY doc_id) b ON a.doc_id = b.doc_id""")
def q_tile_stats(spark, sf):
    return ra.statistics(images(spark, sf), replace(SMALL, block_step=3)).select(
        "doc_id", *[F.round(c, 6).alias(c) for c in ("compression_inconsistency", "noise_inconsistency")])


def max_z_sql(src: str, value: str) -> str:
    return f"""SELECT doc_id, CASE WHEN stddev_pop(tm) > 1e-6 THEN (max(tm) - avg(tm)) / (stddev_pop(tm) + 1e-6) ELSE 0.0 END AS max_z FROM ({tile_sql(src, value, 2, 2)}) t GROUP BY doc_id"""


MAXZ = max_z_sql(NEIGH, "residual")


@query("agg_tile_max_z", f"SELECT doc_id, round(max_z, 6) AS max_z, round({c01('max_z / 6.0')}, 6) AS local_image_anomaly FROM ({MAXZ}) z")
def q_max_z(spark, sf):
    return ra.statistics(images(spark, sf), SMALL).select(
        "doc_id", F.round("local_max_z", 6).alias("max_z"), F.round(fo.local_anomaly(F.col("local_max_z")), 6).alias("local_image_anomaly"))


@query("agg_edge_bands", f"""SELECT doc_id, round(te, 4) AS top_edge, round(me, 4) AS mid_edge, round(be, 4) AS bottom_edge,
 round(greatest(least((rv - lv) / (rv + lv + 1e-6), 1.0), -1.0), 4) AS photo_left_bias, round({c01('abs(t3 - b3) * 4')}, 4) AS edge_inconsistency FROM (
 SELECT doc_id, avg(CASE WHEN r < greatest(1, 8 // 5) THEN e END) AS te, avg(CASE WHEN r >= 8 // 3 AND r < 16 // 3 THEN e END) AS me, avg(CASE WHEN r >= 32 // 5 THEN e END) AS be,
  var_pop(CASE WHEN c < 8 // 3 THEN value END) AS lv, var_pop(CASE WHEN c >= 16 // 3 THEN value END) AS rv,
  avg(CASE WHEN r < 8 // 3 THEN CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END END) AS t3, avg(CASE WHEN r >= 16 // 3 THEN CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END END) AS b3
 FROM (SELECT *, CASE WHEN gradient > 90 THEN 255.0 ELSE 0.0 END::DOUBLE AS e FROM ({NEIGH}) n) n1 GROUP BY doc_id) z""")
def q_edge_bands(spark, sf):
    names = ["top_edge", "mid_edge", "bottom_edge", "photo_left_bias", "edge_inconsistency"]
    return ra.statistics(images(spark, sf), SMALL).select("doc_id", *[F.round(c, 4).alias(c) for c in names])


def _steps(axis, other):
    return f"""SELECT doc_id, k, pos, avg(st) AS ln FROM (SELECT doc_id, {axis} AS pos, abs(value - lag(value) OVER (PARTITION BY doc_id, {other} ORDER BY {axis})) AS st,
 CASE WHEN {axis} % 4 = 0 AND {axis} >= 4 THEN 'b' WHEN {axis} % 4 = 2 AND {axis} > 4 AND {axis} + 1 < 8 THEN 'i' END AS k FROM ({CELLS_SQL}) x) y WHERE k IS NOT NULL GROUP BY doc_id, k, pos"""


@query("q_blockiness", f"""SELECT doc_id, round(avg(CASE WHEN k = 'b' THEN ln END) / (avg(CASE WHEN k = 'i' THEN ln END) + 1e-6), 4) AS blockiness
FROM ({_steps('c', 'r')} UNION ALL {_steps('r', 'c')}) z GROUP BY doc_id""")
def q_blockiness(spark, sf):
    return ra.block_steps(images(spark, sf), 4).select("doc_id", F.round("blockiness", 4).alias("blockiness"))


HSV_SQL = f"""SELECT *, CASE WHEN floor(deg / 2 + 0.5) < 0 THEN floor(deg / 2 + 0.5) + 180 ELSE floor(deg / 2 + 0.5) END AS h FROM (
 SELECT *, CASE WHEN mx = 0 THEN 0.0 ELSE floor(255 * (mx - mn) / mx + 0.5) END AS s, mx AS v, CASE WHEN mx = mn THEN 0.0 WHEN mx = red THEN 60 * (green - blue) / (mx - mn)
  WHEN mx = green THEN 120 + 60 * (blue - red) / (mx - mn) ELSE 240 + 60 * (red - green) / (mx - mn) END AS deg
 FROM (SELECT *, greatest(blue, green, red) AS mx, least(blue, green, red) AS mn FROM ({COLORS_SQL}) c) c1) c2"""


def _frac(cond: str) -> str:
    return f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 4)"


@query("agg_color_fracs", f"""SELECT doc_id, {_frac('h > 90 AND h < 130 AND s > 40')} AS blue_frac, {_frac('(h < 35 OR h > 150) AND s > 20 AND v > 120')} AS warm_frac,
 {_frac('h > 75 AND h < 100 AND s > 30')} AS cyan_frac, {_frac('h > 35 AND h < 85 AND s > 40')} AS green_frac, round(avg(s), 4) AS mean_saturation, round(avg(v), 4) AS mean_value
FROM ({HSV_SQL}) x GROUP BY doc_id""")
def q_colors(spark, sf):
    d = oc.color_fractions(oc.hsv(I.derive(spark, sf, COLORS)))
    return d.select("doc_id", *[F.round(c, 4).alias(c) for c in d.columns if c != "doc_id"])


INK_SQL = f"""SELECT doc_id, avg(CASE WHEN ((h <= 10 OR h >= 170) AND s >= 70 AND v >= 50) OR (h BETWEEN 90 AND 130 AND s >= 60 AND v >= 40) THEN 1.0 ELSE 0.0 END) AS ink FROM ({HSV_SQL}) x GROUP BY doc_id"""


@query("agg_ink_fraction", f"SELECT doc_id, round(ink, 5) AS ink_fraction FROM ({INK_SQL}) i")
def q_ink(spark, sf):
    return oc.ink_fraction(oc.hsv(I.derive(spark, sf, COLORS))).select("doc_id", F.round("ink_fraction", 5).alias("ink_fraction"))


def norm_sql(src: str, extra: str = "") -> str:
    return f"""SELECT x.*, CASE WHEN hi - lo < 1e-6 THEN 0.0 ELSE {c01('(value - lo) / (hi - lo + 1e-6)')} END AS norm FROM ({src}) x
 JOIN (SELECT doc_id, plane, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ({src}) y GROUP BY doc_id, plane) q ON q.doc_id = x.doc_id AND q.plane = x.plane"""


@query("win_percentile_norm", f"SELECT doc_id, plane, r, c, round(norm, 6) AS norm FROM ({norm_sql(PLANES_SQL)}) n")
def q_norm(spark, sf):
    planes = ["ela", "hf", "noise"]
    rows = with_width(ra.normals(images(spark, sf), planes), planes)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), F.round(p, 6).alias("norm")) for p in planes]))
    return rows.select("doc_id", "r", "c", each.alias("x")).select("doc_id", "x.plane", "r", "c", "x.norm")


MIX = f"SELECT doc_id, 'heat' AS plane, r, c, sum(CASE plane WHEN 'ela' THEN 0.45 WHEN 'hf' THEN 0.30 ELSE 0.25 END::DOUBLE * norm) AS value FROM ({norm_sql(PLANES_SQL)}) n GROUP BY doc_id, r, c"
HEAT = f"SELECT doc_id, r, c, norm AS score FROM ({norm_sql(MIX)}) h"


def maps(spark, sf, pixels=False):
    return ra.heat_maps(images(spark, sf), 4, 4, pixels)


def grid(spark, sf):
    cell = maps(spark, sf).select("doc_id", F.posexplode("grid").alias("at", "score")).filter("score IS NOT NULL")
    return cell.select("doc_id", F.floor(F.col("at") / 4).cast("int").alias("grid_row"), (F.col("at") % 4).cast("int").alias("grid_col"), "score",
                       F.lit(8).alias("img_h"), F.lit(8).alias("img_w"))


@query("fs_heat_blend", f"SELECT doc_id, r, c, round(score, 5) AS score FROM ({HEAT}) h")
def q_heat(spark, sf):
    return with_width(maps(spark, sf, pixels=True), ["score"]).select("doc_id", "r", "c", F.round("score", 5).alias("score"))


GRID = f"SELECT doc_id, ((r + 1) * 4 - 1) // 8 AS gr, ((c + 1) * 4 - 1) // 8 AS gc, round(avg(score) + 1e-9, 4) AS score FROM ({HEAT}) h GROUP BY ALL"


@query("fs_grid", f"SELECT doc_id, gr AS grid_row, gc AS grid_col, score FROM ({GRID}) g")
def q_grid(spark, sf):
    return grid(spark, sf).select("doc_id", "grid_row", "grid_col", "score")


@query("fs_heat_summary", f"""SELECT doc_id, round(least(max(score), 1.0) + 1e-9, 4) AS peak_score, round(avg(score) + 1e-9, 4) AS mean_score,
 round(avg(CASE WHEN score >= 0.65 THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS high_anomaly_coverage FROM ({HEAT}) h GROUP BY doc_id""")
def q_heat_summary(spark, sf):
    return maps(spark, sf).select("doc_id", "peak_score", "mean_score", "high_anomaly_coverage")


@query("top_hotspots", f"""SELECT doc_id, rank, gr AS grid_row, gc AS grid_col, score, gc * 2 AS x, gr * 2 AS y, 2 AS w, 2 AS h FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gr DESC, gc DESC) AS rank FROM ({GRID}) g WHERE score >= 0.65) t WHERE rank <= 8""")
def q_hotspots(spark, sf):
    return oc.hotspots(grid(spark, sf), 4, 4)


def copy_sql(value: str, levels: int) -> str:
    """Blocks with the same steps from their mean; how alike the outermost two by rows or by columns are."""
    end = "arg_{}({{'v': v, 'm': m, 'sd': sd, 'br': br, 'bc': bc}}, {})"
    by_row, by_col = "br * 1000 + bc", "bc * 1000 + br"

    def alike(a: str, z: str) -> str:
        dot = f"list_sum(list_transform(range(1, 5), lambda i: ({a}.v[i] - {a}.m) * ({z}.v[i] - {z}.m)))"
        return f"CASE WHEN greatest(abs({a}.br - {z}.br), abs({a}.bc - {z}.bc)) * 2 >= 4 THEN {dot} / (4 * {a}.sd * {z}.sd) END"

    return f"""SELECT doc_id, CASE WHEN x IS NOT NULL THEN {c01('x')} END AS copied FROM (SELECT doc_id, max(greatest({alike('p', 'q')}, {alike('s', 't')})) AS x FROM (
 SELECT doc_id, {end.format('min', by_row)} AS p, {end.format('max', by_row)} AS q, {end.format('min', by_col)} AS s, {end.format('max', by_col)} AS t FROM (
  SELECT *, list_transform(v, lambda x: CAST(round((x - m) / {levels}) AS INT)) AS sig FROM (
   SELECT doc_id, r // 2 AS br, c // 2 AS bc, list(x ORDER BY r, c) AS v, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT doc_id, r, c, {value} AS x FROM ({CELLS_SQL}) c0) c1 GROUP BY ALL) b0
  WHERE sd > 1e-6) b1 GROUP BY doc_id, sig HAVING count(*) > 1) e GROUP BY doc_id) e1"""


@query("join_block_copy", f"""SELECT d.doc_id, coalesce(round(copied, 4), -1.0) AS copy_move_indicators FROM (SELECT vec_id AS doc_id FROM embeddings) d
LEFT JOIN ({copy_sql('floor(value / 40) * 10.0::DOUBLE', 10)}) k ON k.doc_id = d.doc_id""")
def q_copies(spark, sf):
    found = ra.copies(images(spark, sf), replace(SMALL, levels=10.0), "flat")
    return found.select("doc_id", F.coalesce(F.round("copy_move_indicators", 4), F.lit(-1.0)).alias("copy_move_indicators"))


# --- signals -----------------------------------------------------------------------------

SIGNALS = "SELECT o_orderkey AS doc_id, " + ", ".join(
    f"CAST(o_orderkey * {m} % {p} AS DOUBLE) / {p}.0 AS {k}" for (k, m, p) in zip(
        TAMPER_WEIGHTS, (3, 5, 7, 11, 13, 17), (101, 103, 107, 109, 113, 127))) + " FROM {orders}"
SIG = I.plain(SIGNALS)


def review_sql(src: str) -> str:
    scored = ("SELECT *, greatest(least(" + " + ".join(f"round({k}, 4) * {w}" for k, w in TAMPER_WEIGHTS.items()) + ", 1.0), 0.0) AS s, concat_ws(',', "
              + ", ".join(f"CASE WHEN round({k}, 4) > {t} THEN '{k}' END" for k, t in TAMPER_THRESHOLDS.items()) + f") AS flags FROM ({src}) x")
    return f"SELECT *, round(s + 1e-9, 4) AS review_score, CASE WHEN s >= 0.65 THEN 'ELEVATED_REVIEW' WHEN s >= 0.4 OR flags <> '' THEN 'MILD_REVIEW' ELSE 'LOW_SIGNAL' END AS severity FROM ({scored}) r0"


REVIEW2 = review_sql(SIG)


def _review(spark, sf):
    return fo.review(I.derive(spark, sf, SIGNALS))


query("fs_review_score", f"SELECT doc_id, review_score FROM ({REVIEW2}) r")(lambda s, sf: _review(s, sf).select("doc_id", "review_score"))
query("fs_flags", f"SELECT doc_id, flags FROM ({REVIEW2}) r")(lambda s, sf: _review(s, sf).select("doc_id", F.array_join("flags", ",").alias("flags")))
query("fs_severity", f"SELECT doc_id, severity FROM ({REVIEW2}) r")(lambda s, sf: _review(s, sf).select("doc_id", "severity"))

ELA = f"SELECT m.doc_id, round({c01('0.55 * (mr / 25.0) + 0.45 * (z.max_z / 6.0)')}, 6) AS ela_inconsistency FROM (SELECT doc_id, avg(residual) AS mr FROM ({NEIGH}) n GROUP BY doc_id) m JOIN ({MAXZ}) z ON z.doc_id = m.doc_id"


@query("fs_ela_score", ELA)
def q_ela(spark, sf):
    d = ra.statistics(images(spark, sf), SMALL)
    return d.select("doc_id", F.round(fo.ela_score(F.col("noise_level"), F.col("local_max_z")), 6).alias("ela_inconsistency"))


def _cv(value: str, stat: str, step: int) -> str:
    return f"SELECT doc_id, {c01(f'stddev_pop({stat}) / (avg({stat}) + 1e-6) / 5')} AS cv FROM ({tile_sql(NEIGH, value, 2, step)}) t GROUP BY doc_id"


_ELA_PLANE = f"SELECT * FROM ({PLANES_SQL}) p0 WHERE plane = 'ela'"
TAMPER_SIGNALS = f"""SELECT z.doc_id, {c01('0.55 * (em.mr / 25.0) + 0.45 * (ez.max_z / 6.0)')} AS ela_inconsistency, co.cv AS compression_inconsistency,
  nz.cv AS noise_inconsistency, {c01('z.max_z / 6.0')} AS local_image_anomaly, ed.x AS edge_inconsistency, coalesce(cm.copied, 0.0) AS copy_move_indicators
 FROM ({MAXZ}) z JOIN ({max_z_sql(_ELA_PLANE, 'value')}) ez ON ez.doc_id = z.doc_id
 JOIN (SELECT doc_id, avg(value) AS mr FROM ({_ELA_PLANE}) p1 GROUP BY doc_id) em ON em.doc_id = z.doc_id
 JOIN ({_cv('residual', 'tv', 4)}) co ON co.doc_id = z.doc_id JOIN ({_cv('laplacian', 'ts', 2)}) nz ON nz.doc_id = z.doc_id
 JOIN (SELECT doc_id, {c01('abs(avg(CASE WHEN r < 8 // 3 THEN e END) - avg(CASE WHEN r >= 16 // 3 THEN e END)) * 4')} AS x
  FROM (SELECT doc_id, r, CASE WHEN gradient > 90 THEN 1.0 ELSE 0.0 END::DOUBLE AS e FROM ({NEIGH}) n) n1 GROUP BY doc_id) ed ON ed.doc_id = z.doc_id
 LEFT JOIN ({copy_sql('value', 40)}) cm ON cm.doc_id = z.doc_id"""
TAMPER = f"""SELECT m.doc_id, severity, review_score, flags, coalesce(n, 0) AS hotspot_count FROM ({review_sql(TAMPER_SIGNALS)}) m
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({GRID}) g WHERE score >= 0.65 GROUP BY doc_id) k ON k.doc_id = m.doc_id"""


@query("job_tamper", TAMPER)
def job_tamper(spark, sf):
    from idsieve.plans.jobs import image_job
    return image_job(images(spark, sf), SMALL).select(
        "doc_id", "severity", "review_score", F.array_join("flags", ",").alias("flags"), "hotspot_count")


# --- text regions ---------------------------------------------------------------------------

REGIONS = """SELECT l_orderkey AS doc_id, l_linenumber AS box_ord, CAST(l_partkey % 700 AS INT) AS x, CAST(l_linenumber * 40 AS INT) AS y,
 CAST(l_suppkey * 3 % 150 AS INT) AS w, CAST(CASE WHEN l_partkey % 17 = 0 THEN 160 + l_partkey % 13 ELSE 1 + l_quantity % 11 END AS INT) AS h, 800 AS doc_w, 400 AS doc_h,
 l_extendedprice / 997.0 AS sharpness, l_discount * 101 + l_tax * 7 AS contrast, l_extendedprice / 7919.0 AS local_residual, 5.0 + l_orderkey % 7 AS global_residual,
 CAST(l_suppkey * 3 % 150 * (1 + l_quantity % 11) AS INT) AS area FROM {lineitem}"""
REGIONS = ("SELECT doc_id, box_ord, max(x) AS x, max(y) AS y, max(w) AS w, max(h) AS h, 800 AS doc_w, 400 AS doc_h, max(sharpness) AS sharpness, "
           "max(contrast) AS contrast, max(local_residual) AS local_residual, CAST(max(global_residual) AS DOUBLE) AS global_residual, max(area) AS area "
           f"FROM ({REGIONS}) r0 GROUP BY doc_id, box_ord")
REG = I.plain(REGIONS)
USABLE = f"SELECT *, h / 400 AS rh, w / 800 AS rw FROM ({REG}) r WHERE w >= 2 AND h >= 2"


def regions(spark, sf):
    return fo.usable_regions(I.derive(spark, sf, REGIONS))


OUTLIERS = f"""SELECT u.doc_id, box_ord, round(rh + 1e-9, 5) AS relative_height, round(med, 5) AS median_height FROM ({USABLE}) u
JOIN (SELECT u.doc_id, any_value(med) AS med, any_value(n) AS n, median(abs(rh - med)) + 1e-9 AS mad FROM ({USABLE}) u JOIN (SELECT doc_id, median(rh) AS med, count(*) AS n FROM ({USABLE}) v GROUP BY doc_id) m ON m.doc_id = u.doc_id GROUP BY u.doc_id) b ON b.doc_id = u.doc_id
WHERE n >= 3 AND abs(round(rh + 1e-9, 5) - med) / mad > 6 AND round(rh + 1e-9, 5) > med * 2.5"""


@query("win_robust_outlier", f"SELECT * FROM ({OUTLIERS}) o")
def q_outlier(spark, sf):
    return fo.height_outliers(regions(spark, sf)).select(
        "doc_id", "box_ord", r(F.col("relative_height"), 5).alias("relative_height"), F.round("median_height", 5).alias("median_height"))


@query("agg_left_align_std", f"""SELECT doc_id, count(*) AS region_count, round(stddev_pop(x / 800) + 1e-9, 4) AS left_alignment_std, round(avg(sharpness) + 1e-9, 2) AS mean_local_sharpness,
 round(avg(contrast) + 1e-9, 2) AS mean_local_contrast, round(avg(rw) + 1e-9, 5) AS mean_relative_width FROM ({USABLE}) u GROUP BY doc_id""")
def q_align(spark, sf):
    return fo.alignment(regions(spark, sf))


SPLICE = f"""SELECT *, CASE WHEN w * h < 16 THEN 'NO_CLEAR_ANOMALY' WHEN q > 2.2 OR q < 0.35 THEN 'ANOMALY_DETECTED' WHEN q > 1.7 OR q < 0.5 THEN 'UNCERTAIN' ELSE 'NO_CLEAR_ANOMALY' END AS splice_status,
 round(least(1.0, abs(ln(q + 1e-6)) / 2.0) + 1e-9, 4) AS splice_score FROM (SELECT *, local_residual / (global_residual + 1e-6) AS q FROM ({USABLE}) u) u1"""


@query("fs_text_splice", f"SELECT doc_id, box_ord, splice_status, splice_score FROM ({SPLICE}) s")
def q_splice(spark, sf):
    return fo.splice(regions(spark, sf)).select("doc_id", "box_ord", "splice_status", "splice_score")


_FIRST = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box_ord) AS rn FROM ({SPLICE}) s"


@query("agg_splice_anomalies", f"SELECT doc_id, count_if(splice_status = 'ANOMALY_DETECTED') AS anomaly_count, count(*) AS regions_read FROM ({_FIRST}) f GROUP BY doc_id")
def q_splice_count(spark, sf):
    return fo.splice_summary(regions(spark, sf))[0]


@query("top_text_regions", f"""SELECT doc_id, box_ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area * least(w / h, 8.0) DESC, box_ord) AS rank FROM ({REG}) r
 WHERE area >= 48 AND area <= 57600 AND w >= 8 AND h >= 6 AND w / h BETWEEN 0.8 AND 28 AND (y + h / 2) / 400 BETWEEN 0.04 AND 0.96) t WHERE rank <= 24""")
def q_top_regions(spark, sf):
    return fo.visual_regions(I.derive(spark, sf, REGIONS)).select("doc_id", "box_ord", "rank")


_OCR_PART, _VIS_PART = "doc_id % 2 = 0 AND box_ord <= 2 OR doc_id % 2 = 1 AND doc_id % 3 > 0", "box_ord >= 2"


@query("set_text_regions_merge", f"""WITH o AS (SELECT doc_id, box_ord, x, y, w, h FROM ({REG}) r WHERE {_OCR_PART}), v AS (SELECT doc_id, box_ord, x, y, w, h FROM ({REG}) r WHERE {_VIS_PART}),
 n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id),
 e AS (SELECT v.*, CASE WHEN n.n IS NULL THEN 'visual_region_fallback' ELSE 'ocr+visual' END AS region_source FROM v LEFT JOIN n ON n.doc_id = v.doc_id
  WHERE coalesce(n.n, 0) < 4 AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = v.doc_id AND o.x = v.x AND o.y = v.y AND o.w = v.w AND o.h = v.h))
SELECT doc_id, box_ord, region_source FROM e UNION ALL SELECT doc_id, box_ord, CASE WHEN doc_id IN (SELECT doc_id FROM e) THEN 'ocr+visual' ELSE 'ocr' END FROM o""")
def q_merge(spark, sf):
    reg = I.derive(spark, sf, REGIONS).select("doc_id", "box_ord", "x", "y", "w", "h")
    return fo.merge_regions(reg.filter(_OCR_PART), reg.filter(_VIS_PART)).select("doc_id", "box_ord", "region_source")


_FACE = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS INT) END AS face_w, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(5 + o_orderkey % 70 AS INT) END AS face_h,
 CAST(o_orderkey * 7 % 311 AS DOUBLE) / 31.0 AS ring_residual, CAST(o_orderkey * 11 % 313 AS DOUBLE) / 37.0 AS inner_residual, o_orderkey * 3 % 3 AS circles,
 CAST(o_orderkey * 13 % 331 AS DOUBLE) / 20011.0 AS ink, CAST(o_orderkey * 17 % 401 AS DOUBLE) / 7.0 AS sharpness, o_orderkey % 40 AS crop_px, o_orderstatus, o_orderpriority FROM {orders}"""
_FSQL = I.plain(_FACE)
PHOTO = f"""SELECT doc_id, CASE WHEN face_w IS NULL THEN 'NOT_APPLICABLE' WHEN face_w < 8 OR face_h < 8 THEN 'UNCERTAIN' ELSE 'ANALYZED' END AS photo_status,
 CASE WHEN face_w IS NULL OR face_w < 8 OR face_h < 8 THEN '' WHEN q > 2.0 OR q < 0.4 THEN 'ANOMALY_DETECTED' WHEN q > 1.6 OR q < 0.55 THEN 'UNCERTAIN' ELSE 'NO_CLEAR_ANOMALY' END AS photo_detection,
 CASE WHEN face_w IS NULL OR face_w < 8 OR face_h < 8 THEN -1.0 ELSE round(least(1.0, abs(ln(q)) / 2.0) + 1e-9, 4) END AS photo_score FROM (SELECT *, (ring_residual + 1e-6) / (inner_residual + 1e-6) AS q FROM ({_FSQL}) f) f1"""


def _photo(spark, sf):
    from idsieve.plans.jobs import photo_job
    return photo_job(I.derive(spark, sf, _FACE)).select(
        "doc_id", "photo_status", F.coalesce("photo_detection", F.lit("")).alias("photo_detection"),
        F.coalesce("photo_score", F.lit(-1.0)).alias("photo_score"))


query("fs_photo_ratio", PHOTO)(_photo)
query("job_photo", f"SELECT photo_status, photo_detection, count(*) AS n FROM ({PHOTO}) p GROUP BY ALL")(
    lambda s, sf: _photo(s, sf).groupBy("photo_status", "photo_detection").agg(F.count(F.lit(1)).alias("n")))

_STAMP = "CASE WHEN circles > 0 AND ink > 0.002 THEN 'DETECTED' WHEN ink > 0.01 THEN 'UNCERTAIN' ELSE 'NO_CLEAR_ANOMALY' END"
query("fs_stamp", f"SELECT doc_id, {_STAMP} AS detection FROM ({_FSQL}) f")(
    lambda s, sf: I.derive(s, sf, _FACE).select("doc_id", fo.stamp(F.col("circles"), F.col("ink")).alias("detection")))


@query("job_stamp", f"SELECT doc_id, round(ink, 5) AS ink_fraction, {_STAMP} AS detection FROM (SELECT *, doc_id * 3 % 3 AS circles FROM ({INK_SQL}) i) j")
def job_stamp(spark, sf):
    from idsieve.plans.jobs import stamp_job
    colors = I.derive(spark, sf, COLORS)
    circles = colors.select("doc_id").distinct().withColumn("circles", F.col("doc_id") * 3 % 3)
    return stamp_job(colors, circles).select("doc_id", F.round("ink_fraction", 5).alias("ink_fraction"), "detection")


query("fs_text_cross", f"SELECT doc_id, CASE WHEN face_w IS NULL THEN 'NOT_FOUND' WHEN crop_px < 16 THEN 'UNCERTAIN' WHEN sharpness > 20 THEN 'CONSISTENT' ELSE 'UNCERTAIN' END AS status FROM ({_FSQL}) f")(
    lambda s, sf: I.derive(s, sf, _FACE).select("doc_id", fo.text_cross(F.col("face_w").isNotNull(), F.col("crop_px"), F.col("sharpness")).alias("status")))

_META_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'UNAVAILABLE' ELSE 'PRESENT' END AS status, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS tag_count, false AS suspicious,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE repeat(o_orderstatus, 150) || '|' || o_orderpriority END AS sample FROM ({_FSQL}) f"""


def _meta(spark, sf):
    from idsieve.plans.jobs import metadata_job
    tags = F.when(F.col("doc_id") % 4 != 0, F.create_map(
        F.lit("Make"), F.expr("repeat(o_orderstatus, 150)"), F.lit("Software"), F.col("o_orderpriority")))
    d = metadata_job(I.derive(spark, sf, _FACE).withColumn("tags", tags))
    return d.select("doc_id", "meta.status", "meta.tag_count", "meta.suspicious", F.coalesce(F.concat_ws(
        "|", F.col("meta.tags_sample")["Make"], F.col("meta.tags_sample")["Software"]), F.lit("")).alias("sample"))


query("fs_metadata", _META_SQL)(_meta)
query("job_metadata", f"SELECT status, tag_count, count(*) AS n FROM ({_META_SQL}) m GROUP BY ALL")(
    lambda s, sf: _meta(s, sf).groupBy("status", "tag_count").agg(F.count(F.lit(1)).alias("n")))


@query("fs_map", f"""SELECT doc_id, CAST(round(ink, 4) AS DOUBLE) AS ela, photo_status FROM (SELECT f.doc_id, f.ink, p.photo_status FROM ({_FSQL}) f JOIN ({PHOTO}) p ON p.doc_id = f.doc_id) z""")
def q_map(spark, sf):
    d = fo.photo_ring(I.derive(spark, sf, _FACE)).withColumn("ela_inconsistency", F.round("ink", 4))
    m = fo.forensic_map(d, {"image": ["ela_inconsistency", "photo_status", "photo_detection"]})
    return m.select("doc_id", F.col("forensics.image.ela_inconsistency").alias("ela"), "forensics.image.photo_status")


_FT = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, 'f' || CAST(l_linenumber AS STRING) AS field, max(CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 1 END) AS has_box, max(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_FT_SQL = I.plain(_FT)


@query("join_text_visual", f"SELECT doc_id, field, CASE WHEN has_box = 0 THEN 'NOT_FOUND' WHEN ord = 3 OR q % 30 < 16 THEN 'UNCERTAIN' WHEN q > 20 THEN 'CONSISTENT' ELSE 'UNCERTAIN' END AS status FROM ({_FT_SQL}) f")
def q_text_visual(spark, sf):
    f = I.derive(spark, sf, _FT).withColumn("bbox", F.when(F.col("has_box") == 1, F.struct(F.lit(0).alias("x"))))
    stats = f.filter("ord <> 3").select("doc_id", "field", (F.col("q") % 30).cast("int").alias("crop_px"), F.col("q").alias("sharpness"))
    return fo.cross_check(f.drop("q", "has_box"), stats).select("doc_id", "field", "status")


@query("job_text_visual", f"""SELECT a.doc_id, a.region_count, coalesce(o.n, 0) AS typography_anomalies, s.anomaly_count FROM (SELECT doc_id, count(*) AS region_count FROM ({USABLE}) u GROUP BY doc_id) a
 LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({OUTLIERS}) o GROUP BY doc_id) o ON o.doc_id = a.doc_id
 JOIN (SELECT doc_id, count_if(splice_status = 'ANOMALY_DETECTED') AS anomaly_count FROM ({_FIRST}) f GROUP BY doc_id) s ON s.doc_id = a.doc_id""")
def job_text_visual(spark, sf):
    from idsieve.plans.jobs import text_visual_job
    return text_visual_job(I.derive(spark, sf, REGIONS)).select("doc_id", "region_count", "typography_anomalies", "anomaly_count")
