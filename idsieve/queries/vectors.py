"""Vectors, prototypes, heads, fusion, calibration and type classification."""

from pyspark.sql import functions as F

from idsieve.functions import vectors as v
from idsieve.functions.common import r
from idsieve.functions.fixed import CLASSIFIER_FEATURES, CORE_TYPES, FILENAME_PATTERNS, FUSION_DIM, FUSION_LAYOUT
from idsieve.operators import classify as oc, model_store as ms, models as om
from idsieve.plans.folders import work_folder
from idsieve.queries import inputs as I
from idsieve.queries.registry import query

E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) t"


def emb(spark, sf):
    return I.table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))


def _join(x: str, fmt: str = "%.4f") -> str:
    return f"array_to_string(list_transform({x}, lambda x: printf('{fmt}', x)), ',')"


def shown(c, n=4):
    return F.array_join(F.transform(c, lambda x: F.format_string(f"%.{n}f", x)), ",")


_N = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"


@query("vec_l2", f"SELECT vec_id, round(list_transform(e, lambda x: x / ({_N} + 1e-12))[1], 5) AS first_value, round({_N}, 5) AS norm FROM {E}")
def q_l2(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(v.l2(F.col("e"))[0], 5).alias("first_value"), F.round(v.norm(F.col("e")), 5).alias("norm"))


@query("vec_cosine", f"""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * f[i])) / ((sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12) * (sqrt(list_sum(list_transform(f, lambda x: x * x))) + 1e-12)), 5) AS cosine
FROM (SELECT vec_id, e, list_reverse(e) AS f FROM {E}) u""")
def q_cosine(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(v.cosine(F.col("e"), F.reverse("e")), 5).alias("cosine"))


@query("vec_summary", f"""SELECT vec_id, len(e) AS dim, round({_N}, 6) AS norm, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std,
 round(e[12] / ({_N} + 1e-12), 6) AS last_print FROM {E}""")
def q_summary(spark, sf):
    return emb(spark, sf).withColumn("s", v.summary(F.col("e"))).select(
        "vec_id", "s.dim", "s.norm", "s.mean", "s.std", F.element_at("s.fingerprint", 12).alias("last_print"))


@query("vec_id", f"SELECT vec_id, left(sha256({_join('e', '%.6f')}), 16) AS embedding_id FROM {E}")
def q_vec_id(spark, sf):
    return emb(spark, sf).select("vec_id", v.vector_id(F.col("e")).alias("embedding_id"))


@query("vec_pad", f"SELECT vec_id, {_join('list_resize(e[1:CAST(vec_id % 20 AS INT)], 12, 0.0)', '%.5f')} AS padded FROM {E}")
def q_pad(spark, sf):
    cut = F.slice("e", F.lit(1), (F.col("vec_id") % 20).cast("int"))
    return emb(spark, sf).select("vec_id", shown(v.pad(cut, 12), 5).alias("padded"))


def softmax_sql(a: str, t: float = 1.0) -> str:
    return (f"list_transform({a}, lambda x: exp((x - list_max({a})) / {t}) / list_sum(list_transform({a}, lambda y: exp((y - list_max({a})) / {t}))))")


@query("softmax", f"SELECT vec_id, round(p[1], 5) AS p1, round(p[7], 5) AS p7, round(list_sum(p), 6) AS total FROM (SELECT vec_id, {softmax_sql('e', 0.15)} AS p FROM {E}) u")
def q_softmax(spark, sf):
    p = emb(spark, sf).withColumn("p", v.softmax(F.col("e"), 0.15))
    return p.select("vec_id", F.round(F.col("p")[0], 5).alias("p1"), F.round(F.col("p")[6], 5).alias("p7"),
                    F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Prototypes: centroids of the first seven labels stand for the core types.
CENTROIDS = """SELECT label, list(m ORDER BY pos) AS proto FROM (SELECT label, pos, avg(x) AS m FROM (
 SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE label < 7) a GROUP BY label, pos) b GROUP BY label"""
_CORE = "['PASSPORT', 'VISA', 'NATIONAL_ID', 'DRIVING_LICENCE', 'PERMIT', 'OTHER', 'UNKNOWN']"


def prototypes(spark, sf):
    long = I.table(spark, sf, "embeddings").filter("label < 7").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("prototype"))
    names = F.array(*[F.lit(t) for t in CORE_TYPES])
    return om.load_prototypes(rows.select(F.element_at(names, F.col("label") + 1).alias("label"), F.col("label").alias("label_ord"), "prototype"))


_COS = "list_sum(list_transform(range(1, 65), lambda i: e[i] * proto[i])) / ((sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12) * (sqrt(list_sum(list_transform(proto, lambda x: x * x))) + 1e-12))"
PROTO = f"""SELECT vec_id, t.label, list(cs ORDER BY plabel) AS cs FROM (SELECT vec_id, t.label, c.label AS plabel, round({_COS}, 4) AS cs FROM {E} CROSS JOIN ({CENTROIDS}) c) t GROUP BY vec_id, t.label"""
PROBS = f"SELECT vec_id, label, cs, list_transform({softmax_sql('cs', 0.15)}, lambda x: round(x + 1e-9, 4)) AS ps FROM ({PROTO}) p"


def scored(spark, sf):
    cat = F.element_at(F.array(*[F.lit(t) for t in (*CORE_TYPES, "PAN", "LIBRARY_CARD", "AADHAAR")]), F.col("label") + 1)
    from idsieve.sources.profiles import category
    d = emb(spark, sf).withColumn("category", F.when(cat == "LIBRARY_CARD", cat).otherwise(category(cat)))
    return om.prototype_scores(d, prototypes(spark, sf))


@query("join_prototype_cross", f"SELECT vec_id, {_join('cs')} AS cosines FROM ({PROTO}) p")
def q_proto(spark, sf):
    return scored(spark, sf).select("vec_id", shown(F.col("raw_cosine")).alias("cosines"))


_CAT = "['PASSPORT', 'VISA', 'NATIONAL_ID', 'DRIVING_LICENCE', 'PERMIT', 'OTHER', 'UNKNOWN', 'NATIONAL_ID', 'OTHER', 'NATIONAL_ID'][label + 1]"
ALIGN = f"""SELECT vec_id, {_CORE}[list_position(ps, list_max(ps))] AS top_label, list_max(ps) AS top_probability, ps[list_position({_CORE}, {_CAT})] AS own,
 CASE WHEN {_CORE}[list_position(ps, list_max(ps))] = {_CAT} AND list_max(ps) >= 0.2 THEN 'ALIGNED' WHEN ps[list_position({_CORE}, {_CAT})] >= 0.15 THEN 'PARTIAL' ELSE 'DIVERGENT' END AS agreement FROM ({PROBS}) p"""


@query("proto_alignment", f"SELECT vec_id, top_label, top_probability, own AS own_probability, agreement FROM ({ALIGN}) a")
def q_align(spark, sf):
    return om.alignment(scored(spark, sf)).select("vec_id", "top_label", "top_probability", "own_probability", "agreement")


# Fixed head weights for scoring queries: alternating ramps, so that both classes appear.
W = [[((i % 5) - 2) / 1.5 for i in range(64)], [((i % 7) - 3) / 2.0 for i in range(64)]]
B = [0.05, -0.05]


def arr(xs) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"


def lin(vec: str, w, b, n: int) -> str:
    return "[" + ", ".join(f"list_sum(list_transform(range(1, {n + 1}), lambda i: {vec}[i] * ({arr(wi)})[i])) + {float(bi)!r}::DOUBLE" for wi, bi in zip(w, b)) + "]"


HEAD = f"""SELECT vec_id, label, e, CASE WHEN label = 9 THEN NULL ELSE p END AS p FROM (SELECT vec_id, label, e, {softmax_sql('z')} AS p FROM (SELECT vec_id, label, e, {lin('u', W, B, 64)} AS z
 FROM (SELECT *, list_transform(e, lambda x: x / ({_N} + 1e-12)) AS u FROM {E}) u0) u1) u2"""


HEAD_SQL = f"SELECT vec_id, CASE WHEN p IS NULL THEN 'NOT_ASSESSED' ELSE 'SCORED' END AS status, coalesce(round(p[1] + 1e-9, 4), -1.0) AS authentic, CASE WHEN p IS NULL THEN '' WHEN p[1] >= p[2] THEN 'authentic' ELSE 'tampered' END AS label FROM ({HEAD}) h"


@query("head_score", HEAD_SQL)
def q_head(spark, sf):
    # Label 9 vectors arrive one value short and must not be scored.
    d = emb(spark, sf).withColumn("x", F.when(F.col("label") == 9, F.slice("e", 1, 63)).otherwise(F.col("e")))
    return d.withColumn("h", om.head(F.col("x"), W, B, 64)).select(
        "vec_id", "h.status", F.coalesce("h.authentic", F.lit(-1.0)).alias("authentic"), F.coalesce("h.label", F.lit("")).alias("label"))


@query("head_score_batch", HEAD_SQL)
def q_head_batch(spark, sf):
    """The same head as a stored model: one matrix product per batch of vectors."""
    d = emb(spark, sf).withColumn("x", F.when(F.col("label") == 9, F.slice("e", 1, 63)).otherwise(F.col("e")))
    d = d.withColumn("p", ms.probabilities(F.col("x"), ms.Model("head", 1, W, B), unit=True))
    return d.select(
        "vec_id", F.when(F.col("p").isNull(), "NOT_ASSESSED").otherwise("SCORED").alias("status"), F.coalesce(F.round(F.col("p")[0] + 1e-9, 4), F.lit(-1.0)).alias("authentic"),
        F.when(F.col("p").isNull(), "").when(F.col("p")[0] >= F.col("p")[1], "authentic").otherwise("tampered").alias("label"))


@query("logreg_predict", f"SELECT vec_id, round(p[1], 5) AS p1, round(p[2], 5) AS p2 FROM (SELECT vec_id, {softmax_sql('z')} AS p FROM (SELECT vec_id, {lin('e', W, B, 64)} AS z FROM {E}) u) w")
def q_predict(spark, sf):
    p = emb(spark, sf).withColumn("p", om.class_probabilities(F.col("e"), W, B))
    return p.select("vec_id", F.round(F.col("p")[0], 5).alias("p1"), F.round(F.col("p")[1], 5).alias("p2"))




@query("vision_status", "SELECT vec_id, CASE WHEN a AND b AND c THEN 'OK' WHEN a OR b OR c THEN 'PARTIAL' ELSE 'NOT_ASSESSED' END AS vision_status FROM (SELECT vec_id, label % 2 = 0 AS a, label % 3 = 0 AS b, label % 5 = 0 AS c FROM embeddings) t")
def q_vision(spark, sf):
    c = F.col("label")
    return emb(spark, sf).select("vec_id", om.vision_status(c % 2 == 0, c % 3 == 0, c % 5 == 0).alias("vision_status"))


# Fusion inputs from slices of the embedding and its id.
_FIN = {
    "enet_fp": "e[1:12]", "enet_auth": "CASE WHEN label % 4 = 0 THEN NULL ELSE abs(e[3]) * 2 END", "enet_tamp": "1 - abs(e[3]) * 2",
    "enet_present": "CASE WHEN label % 4 = 0 THEN 0.0 ELSE 1.0 END", "vit_fp": "e[13:20]", "vit_auth": "CASE WHEN label % 3 = 0 THEN NULL ELSE abs(e[5]) * 2 END",
    "vit_tamp": "abs(e[6])", "vit_present": "CASE WHEN label % 3 = 0 THEN 0.0 ELSE 1.0 END", "clip_fp": "e[21:36]", "clip_proto": "e[37:43]",
    "clip_present": "CASE WHEN label IN (0, 5) THEN 0.0 ELSE 1.0 END", "evidence_quality": "CAST(vec_id % 97 AS DOUBLE) / 97.0", "ocr_confidence": "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id % 89 AS DOUBLE) / 89.0 END",
    "field_completeness": "CAST(vec_id % 7 AS DOUBLE) / 7.0", "doc_type_confidence": "CAST(vec_id % 11 AS DOUBLE) / 11.0", "mrz_check_pass_rate": "CAST(vec_id % 3 AS DOUBLE) / 3.0", "mrz_parsed": "CAST(vec_id % 2 AS DOUBLE)",
}


def fusion_inputs(spark, sf):
    def sp(x):
        import re
        x = re.sub(r"e\[(\d+):(\d+)\]", lambda m: f"slice(e, {m[1]}, {int(m[2]) - int(m[1]) + 1})", x)
        return re.sub(r"e\[(\d+)\]", r"element_at(e, \1)", x)
    return emb(spark, sf).selectExpr("vec_id", "vec_id AS doc_id", "label", *[f"CAST({sp(x)} AS {'array<double>' if n.endswith(('fp', 'proto')) else 'double'}) AS {n}" for n, x in _FIN.items()])


FIN = "SELECT vec_id, label, " + ", ".join(f"{x} AS {n}" for n, x in _FIN.items()) + f" FROM {E}"
FVEC = "SELECT *, " + " || ".join(f"list_resize({n}, {k}, 0.0)" if k > 1 else f"[coalesce({n}, 0.0)::DOUBLE]" for n, k in FUSION_LAYOUT) + f" AS fv FROM ({FIN}) f"
FW = [[((i * 3 % 11) - 5) / 2.0 for i in range(FUSION_DIM)], [((i * 5 % 13) - 6) / 3.0 for i in range(FUSION_DIM)]]
FB = [0.1, -0.1]
FUSED = f"""SELECT *, CASE WHEN p IS NULL THEN 'NOT_ASSESSED' ELSE 'FUSED' END AS fusion_status, round(p[1] + 1e-9, 4) AS fa, round(p[2] + 1e-9, 4) AS ft,
 abs(CASE WHEN enet_auth IS NULL THEN vit_auth WHEN vit_auth IS NULL THEN enet_auth ELSE (enet_auth + vit_auth) / 2 END - round(p[1] + 1e-9, 4)) AS gap
FROM (SELECT *, CASE WHEN enet_present + vit_present + clip_present > 0 THEN {softmax_sql('z')} END AS p FROM (SELECT *, {lin('u', FW, FB, FUSION_DIM)} AS z
 FROM (SELECT *, list_transform(fv, lambda x: x / (sqrt(list_sum(list_transform(fv, lambda y: y * y))) + 1e-12)) AS u FROM ({FVEC}) g) g1) g2) g3"""


@query("fusion_vector", f"SELECT vec_id, len(fv) AS dim, {_join('fv')} AS features FROM ({FVEC}) g")
def q_fvec(spark, sf):
    d = om.fusion_vector(fusion_inputs(spark, sf))
    return d.select("vec_id", F.size("fusion_vector").alias("dim"), shown(F.col("fusion_vector")).alias("features"))


AGREE = "CASE WHEN gap IS NULL THEN 'NOT_ASSESSED' WHEN gap < 0.15 THEN 'AGREE' WHEN gap < 0.3 THEN 'PARTIAL' ELSE 'DIVERGE' END"


@query("fusion_score", f"SELECT vec_id, fusion_status, coalesce(fa, -1.0) AS authentic, coalesce(ft, -1.0) AS tampered, {AGREE} AS head_agreement FROM ({FUSED}) g")
def q_fuse(spark, sf):
    return om.fuse(fusion_inputs(spark, sf), FW, FB).select(
        "vec_id", "fusion_status", F.coalesce("fusion_authentic", F.lit(-1.0)).alias("authentic"),
        F.coalesce("fusion_tampered", F.lit(-1.0)).alias("tampered"), "head_agreement")


@query("calib_apply", f"""SELECT vec_id, CASE WHEN skip THEN 'SKIPPED' WHEN fusion_status <> 'FUSED' THEN 'NOT_ASSESSED' ELSE 'CALIBRATED' END AS calibration_status,
 CASE WHEN skip OR fusion_status <> 'FUSED' THEN -1.0 ELSE round(1 / (1 + exp(-(1.3 * ln(q / (1 - q)) + 0.2))) + 1e-9, 4) END AS authenticity_estimate
FROM (SELECT *, label = 1 OR vec_id % 6 = 0 AS skip, least(greatest(fa, 1e-6), 1 - 1e-6) AS q FROM ({FUSED}) g) h""")
def q_calibrate(spark, sf):
    d = om.fuse(fusion_inputs(spark, sf), FW, FB).withColumns({
        "prior_decision": F.when(F.col("label") == 1, F.lit("INCONCLUSIVE")).otherwise(F.lit("PENDING")),
        "quality_ok": F.col("vec_id") % 6 != 0})
    return om.calibrate(d, 1.3, 0.2).select(
        "vec_id", "calibration_status", F.coalesce("authenticity_estimate", F.lit(-1.0)).alias("authenticity_estimate"))


@query("job_features", f"""SELECT h.vec_id, CASE WHEN h.p IS NULL THEN -1.0 ELSE round(h.p[1] + 1e-9, 4) END AS authentic, a.top_label, a.agreement FROM (SELECT vec_id, {softmax_sql('z')} AS p FROM (SELECT vec_id, {lin('u', W, B, 64)} AS z
 FROM (SELECT *, list_transform(e, lambda x: x / ({_N} + 1e-12)) AS u FROM {E}) u0) u1) h JOIN ({ALIGN}) a ON a.vec_id = h.vec_id""")
def job_features(spark, sf):
    from idsieve.plans.jobs import features_job
    cat = F.element_at(F.array(*[F.lit(t) for t in ("PASSPORT", "VISA", "NATIONAL_ID", "DRIVING_LICENCE", "PERMIT", "OTHER", "UNKNOWN", "NATIONAL_ID", "OTHER", "NATIONAL_ID")]), F.col("label") + 1)
    d = I.table(spark, sf, "embeddings").withColumn("category", cat)
    return features_job(d, W, B, 64, prototypes(spark, sf)).select("vec_id", F.col("head.authentic").alias("authentic"), "top_label", "agreement")


# --- training (rows-only) ---------------------------------------------------------------

def _trained(spark, sf):
    rows = emb(spark, sf).select("vec_id", F.col("e").alias("features"), (F.col("label") < 5).cast("int").alias("label"))
    return rows, om.train(rows, normalize=True, max_iter=50)


@query("logreg_train")
def q_train(spark, sf):
    rows, model = _trained(spark, sf)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = rows.withColumn("h", om.head(F.col("features"), w, b, 64))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h.tampered"), 2).alias("mean_class1"))


@query("calib_fit")
def q_calib_fit(spark, sf):
    d = om.fuse(fusion_inputs(spark, sf), FW, FB).filter("fusion_authentic IS NOT NULL").withColumn(
        "is_authentic", F.col("fusion_authentic") + F.col("vec_id") % 5 / 10.0 > 0.6)
    a, b = om.fit_platt(d, "fusion_authentic", "is_authentic")
    return om.calibrate(d.withColumns({"prior_decision": F.lit("PENDING"), "quality_ok": F.lit(True)}), a, b).select(
        "vec_id", "fusion_authentic", "authenticity_estimate")


@query("train_set_synth")
def q_synth(spark, sf):
    rows = om.perturbed(emb(spark, sf), "vec_id", "e", copies=2, scale=0.1)
    return rows.select("vec_id", "copy", "label", F.size("features").alias("dim"))


def _never():
    raise AssertionError("a stored model is fitted again")


@query("sink_models")
def q_models(spark, sf):
    """Fitted once and written, then read back by a second call that must not fit."""
    path = work_folder(spark, "models")
    first = ms.load_or_fit(spark, path, "head", lambda: _trained(spark, sf)[1])
    if ms.load_or_fit(spark, path, "head", _never) != first:
        raise AssertionError("a stored model came back otherwise")
    return ms.stored_weights(spark, path)


@query("job_train_models")
def job_train(spark, sf):
    """Both models of the screening: written with their versions; a refit adds a version."""
    path, rows = work_folder(spark, "models"), emb(spark, sf).select(F.col("e").alias("features"), "label")
    ms.load_or_fit(spark, path, "document_type", lambda: om.train(rows, max_iter=30))
    fit = lambda reg: om.train(rows.withColumn("label", (F.col("label") < 5).cast("int")), normalize=True, max_iter=20, reg=reg)
    ms.load_or_fit(spark, path, "head", lambda: fit(0.0))
    ms.refit(spark, path, "head", lambda: fit(0.1))
    return ms.stored_weights(spark, path).groupBy("model", "version", "class").agg(F.count(F.lit(1)).alias("n_weights"))


# --- document type -------------------------------------------------------------------------

CUES = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 12 WHEN 0 THEN 'my_visa_scan.png' WHEN 1 THEN 'passport-1.jpg' WHEN 2 THEN 'PAN card.png' WHEN 3 THEN 'aadhaar.png' WHEN 4 THEN 'driving_licence.png'
  WHEN 5 THEN 'work permit.pdf' WHEN 6 THEN 'national-id.png' WHEN 7 THEN 'japan.png' ELSE 'scan' || CAST(o_orderkey AS STRING) || '.png' END AS filename,
 300 + o_orderkey % 1400 AS width, 250 + o_orderkey * 7 % 1703 AS height, CAST(o_orderkey * 11 % 101 AS DOUBLE) / 101.0 AS blue_frac, CAST(o_orderkey * 13 % 103 AS DOUBLE) / 103.0 AS warm_frac,
 CAST(o_orderkey * 17 % 107 AS DOUBLE) / 107.0 AS cyan_frac, CAST(o_orderkey * 19 % 109 AS DOUBLE) / 109.0 AS green_frac, CAST(o_orderkey * 23 % 255 AS DOUBLE) AS mean_saturation, CAST(o_orderkey * 29 % 255 AS DOUBLE) AS mean_value,
 CAST(o_orderkey * 31 % 211 AS DOUBLE) / 3.0 AS top_edge, CAST(o_orderkey * 37 % 223 AS DOUBLE) / 3.0 AS mid_edge, CAST(o_orderkey * 41 % 227 AS DOUBLE) / 3.0 AS bottom_edge, CAST(o_orderkey * 43 % 199 AS DOUBLE) / 99.0 - 1.0 AS photo_left_bias FROM {orders}"""
CUES_SQL = I.plain(CUES)
_TOK = "regexp_replace(lower(filename), '[^a-z0-9]+', ' ', 'g')"


def pri(t):
    return f"CASE WHEN regexp_matches({_TOK}, '{'|'.join(FILENAME_PATTERNS[t])}') THEN 0.35 ELSE 0.0 END::DOUBLE"


PRIORS = f"""SELECT *, {pri('PAN')} AS p_pan, {pri('AADHAAR')} AS p_aad, {pri('PASSPORT')} AS p_pass, {pri('VISA')} AS p_visa, {pri('DRIVING_LICENCE')} AS p_dl, {pri('PERMIT')} AS p_perm, {pri('NATIONAL_ID')} AS p_nid0 FROM ({CUES_SQL}) c"""
FEATS = f"""SELECT *, exp(-((aspect - 1.586) * (aspect - 1.586)) / (2 * 0.12 * 0.12)) AS card, exp(-((aspect - 1.42) * (aspect - 1.42)) / (2 * 0.18 * 0.18)) AS tall, greatest(p_nid0, p_aad * 0.5) AS p_nid, greatest(0.0, photo_left_bias) AS ph
FROM (SELECT *, greatest(width, height) / least(width, height) AS aspect FROM ({PRIORS}) p) q"""
RAWH = f"""SELECT *, [0.05 + 0.28 * greatest(tall, 1.0 - abs(aspect - 1.35) / 2) + 0.25 * blue_frac + 0.12 * ph + CASE WHEN bottom_edge > mid_edge * 1.05 THEN 0.12 ELSE 0.0 END + p_pass,
 0.05 + 0.22 * card + 0.18 * green_frac + 0.2 * p_visa + 0.1 * warm_frac + p_visa, 0.05 + 0.32 * card + 0.18 * cyan_frac + 0.1 * warm_frac + 0.12 * ph + 0.15 * greatest(p_nid, p_aad, p_pan) + p_nid,
 0.05 + 0.3 * card + 0.12 * blue_frac + 0.12 * ph + 0.25 * p_dl + p_dl, 0.05 + 0.2 * card + 0.15 * warm_frac + 0.3 * p_perm + p_perm, 0.17, 0.13]::DOUBLE[] AS raw FROM ({FEATS}) f"""
HEUR = f"SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS hp FROM ({RAWH}) g"
_FV = "[aspect, card, tall, blue_frac, warm_frac, cyan_frac, mean_saturation / 255.0, mean_value / 255.0, top_edge, mid_edge, bottom_edge, photo_left_bias, p_pass, p_visa, p_nid, p_dl, p_perm, p_pan, p_aad]::DOUBLE[]"
CW = [[((i * (k + 2) % 9) - 4) / 40.0 for i in range(len(CLASSIFIER_FEATURES))] for k in range(7)]
CB = [0.01 * k for k in range(7)]
BLEND = f"SELECT *, list_transform(mx, lambda x: x / list_sum(mx)) AS tp FROM (SELECT *, list_transform(range(1, 8), lambda i: 0.55 * ml[i] + 0.45 * hp[i]) AS mx FROM (SELECT *, {softmax_sql('z')} AS ml FROM (SELECT *, {lin('fv', CW, CB, 19)} AS z FROM (SELECT *, {_FV} AS fv FROM ({HEUR}) h0) h1) h2) h3) h4"
GATED = f"""SELECT *, {_CORE}[list_position(tp, list_max(tp))] AS top, list_max(tp) AS pmax, list_max(tp) - list_reverse_sort(tp)[2] AS margin FROM ({BLEND}) b"""
TYPED = f"""SELECT *, CASE WHEN core <> 'NATIONAL_ID' THEN core WHEN ps > asx AND ps > 0.25 THEN 'PAN' WHEN asx > ps AND asx > 0.25 THEN 'AADHAAR' ELSE 'NATIONAL_ID' END AS document_type FROM (
 SELECT *, CASE WHEN pmax < 0.28 OR (margin < 0.05 AND pmax < 0.4) THEN 'UNKNOWN' ELSE top END AS core, round(CASE WHEN pmax < 0.28 OR (margin < 0.05 AND pmax < 0.4) THEN least(pmax, 0.4) ELSE pmax END + 1e-9, 4) AS conf,
 p_pan + 0.15 * warm_frac + 0.1 * greatest(0.0, -photo_left_bias) AS ps, p_aad + 0.2 * cyan_frac + 0.1 * ph AS asx FROM ({GATED}) g) t"""


def cues(spark, sf):
    return I.derive(spark, sf, CUES)


@query("cl_filename_priors", f"SELECT doc_id, p_pan, p_aad, p_pass, p_visa, p_dl, p_perm, p_nid0 AS p_nid, CASE WHEN p_pan + p_aad + p_pass + p_visa + p_dl + p_perm + p_nid0 = 0 THEN 0.05 ELSE 0.0 END::DOUBLE AS p_other FROM ({PRIORS}) p")
def q_priors(spark, sf):
    d = oc.filename_priors(cues(spark, sf))
    return d.selectExpr("doc_id", "prior_pan p_pan", "prior_aadhaar p_aad", "prior_passport p_pass", "prior_visa p_visa", "prior_dl p_dl", "prior_permit p_perm", "prior_national_id p_nid", "prior_other p_other")


@query("cl_features", f"SELECT doc_id, {_join('list_transform(fv, lambda y: round(y + 1e-9, 4))')} AS features FROM (SELECT doc_id, {_FV} AS fv FROM ({FEATS}) f) g")
def q_features(spark, sf):
    d = oc.feature_vector(oc.features(oc.filename_priors(cues(spark, sf))))
    return d.select("doc_id", shown(F.transform("features", lambda x: r(x))).alias("features"))


@query("cl_heuristic", f"SELECT doc_id, {_join('hp', '%.5f')} AS scores FROM ({HEUR}) h")
def q_heuristic(spark, sf):
    d = oc.heuristic(oc.features(oc.filename_priors(cues(spark, sf))))
    return d.select("doc_id", shown(F.col("heuristic"), 5).alias("scores"))


def _gated(spark, sf):
    d = oc.heuristic(oc.feature_vector(oc.features(oc.filename_priors(cues(spark, sf)))))
    return oc.gate(oc.blend(d, CW, CB))


@query("cl_blend_gate", f"SELECT doc_id, core AS core_type, conf AS type_confidence FROM ({TYPED}) t")
def q_gate(spark, sf):
    return _gated(spark, sf).select("doc_id", "core_type", "type_confidence")


@query("win_rank_types", f"""SELECT doc_id, round(margin, 5) AS margin, len(alt) AS n_alternatives, coalesce({_CORE}[list_position(tp, alt[1])], '') AS second FROM (
 SELECT *, list_filter(list_reverse_sort(tp)[2:4], lambda x: x > 0.04) AS alt FROM ({GATED}) g) t""")
def q_rank(spark, sf):
    return _gated(spark, sf).select(
        "doc_id", F.round("margin", 5).alias("margin"), F.size("alternatives").alias("n_alternatives"),
        F.coalesce(F.get("alternatives", 0)["label"], F.lit("")).alias("second"))


@query("cl_subtype", f"SELECT doc_id, core AS core_type, document_type FROM ({TYPED}) t WHERE core = 'NATIONAL_ID'")
def q_subtype(spark, sf):
    return oc.subtype(_gated(spark, sf)).filter("core_type = 'NATIONAL_ID'").select("doc_id", "core_type", "document_type")


@query("job_classify", f"SELECT doc_id, document_type, conf AS type_confidence FROM ({TYPED}) t")
def job_classify(spark, sf):
    from idsieve.plans.jobs import classify_job
    return classify_job(cues(spark, sf), CW, CB).select("doc_id", "document_type", "type_confidence")
