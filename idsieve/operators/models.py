"""Vector scoring and logistic models: heads, prototypes, fusion, calibration, training.

Weights are small (a few classes by a fixed dimension) and enter expressions as
literal arrays, so that scoring is a plain projection without a join.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.functions import vectors as v
from idsieve.functions.common import case, clip, let, r
from idsieve.functions.fixed import FUSION_DIM, FUSION_LAYOUT

EPS = 1e-6


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def linear_scores(vec: Column, weights, bias) -> Column:
    """One score per class: w . x + b."""
    return F.array(*[v.dot(vec, literal_vector(w)) + F.lit(float(b)) for w, b in zip(weights, bias)])


def head(vec: Column, weights, bias, dim: int) -> Column:
    """struct(status, authentic, tampered, label): unit vector, linear, softmax; class 0 is authentic."""
    unit = v.l2(vec)
    probs = let(unit, lambda u: v.softmax(linear_scores(u, weights, bias)))
    return let(F.when(F.size(vec) == dim, probs), lambda p: F.struct(
        F.when(p.isNotNull(), F.lit("SCORED")).otherwise(F.lit("NOT_ASSESSED")).alias("status"),
        r(p[0]).alias("authentic"), r(p[1]).alias("tampered"),
        case((p[0] >= p[1], "authentic"), (p[0] < p[1], "tampered")).alias("label")))


def class_probabilities(vec: Column, weights, bias) -> Column:
    """Multinomial prediction on the raw vector."""
    return v.softmax(linear_scores(vec, weights, bias))


MAX_PROTOTYPES = 64


def load_prototypes(prototypes: DataFrame) -> list[tuple[str, list[float]]]:
    """prototypes(label, label_ord, prototype) as a list. There is one prompt per core type;
    a table with more than 64 rows is not a prompt list and is refused."""
    rows = prototypes.select("label_ord", "label", F.col("prototype").cast("array<double>").alias("p")
                             ).take(MAX_PROTOTYPES + 1)
    if len(rows) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    return [(x["label"], x["p"]) for x in sorted(rows, key=lambda x: x["label_ord"])]


def prototype_scores(emb: DataFrame, prototypes: list[tuple[str, list[float]]],
                     temperature: float = 0.15) -> DataFrame:
    """Cosine to every prototype, softmax over them, per embedding. A projection: no join."""
    e = F.col("embedding").cast("array<double>")
    cos = F.array(*[F.round(v.cosine(e, literal_vector(p)), 4) for _, p in prototypes])
    return emb.withColumn("raw_cosine", cos).withColumn(
        "probabilities", F.transform(v.softmax(F.col("raw_cosine"), temperature), lambda x: r(x))
    ).withColumn("labels", F.array(*[F.lit(name) for name, _ in prototypes]))


def ranked(probabilities: Column, labels: Column) -> Column:
    """Array of struct(probability, label), best first; the earlier label wins ties."""
    pairs = F.zip_with(probabilities, labels, lambda p, l: F.struct(p.alias("probability"), l.alias("label")))
    at = F.transform(pairs, lambda x, i: F.struct(
        (-x["probability"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(at), lambda s: s["x"])


def alignment(scored: DataFrame, predicted: str = "category") -> DataFrame:
    """Add top_label, top_probability, own_probability, agreement with the predicted category."""
    d = scored.withColumn("_rank", ranked(F.col("probabilities"), F.col("labels")))
    target = F.when(F.array_contains("labels", F.col(predicted)), F.col(predicted)).otherwise(F.lit("OTHER"))
    d = d.withColumns({
        "top_label": F.col("_rank")[0]["label"], "top_probability": F.col("_rank")[0]["probability"],
        "_target": target,
    })
    d = d.withColumn("own_probability", F.try_element_at(
        "probabilities", F.nullif(F.array_position("labels", F.col("_target")), F.lit(0)).cast("int")))
    return d.withColumn("agreement", case(
        ((F.col("top_label") == F.col("_target")) & (F.col("top_probability") >= 0.2), "ALIGNED"),
        (F.col("own_probability") >= 0.15, "PARTIAL"),
        (F.col("own_probability").isNotNull(), "DIVERGENT"), otherwise="NOT_ASSESSED",
    )).drop("_rank", "_target")


def vision_status(*present: Column) -> Column:
    n = sum((F.coalesce(p, F.lit(False)).cast("int") for p in present[1:]),
            F.coalesce(present[0], F.lit(False)).cast("int"))
    return case((n == len(present), "OK"), (n > 0, "PARTIAL"), otherwise="NOT_ASSESSED")


def fusion_vector(inputs: DataFrame) -> DataFrame:
    """The 60 features in layout order; missing parts become zeros at this consumer only."""
    parts = []
    for name, width in FUSION_LAYOUT:
        parts.append(v.pad(F.col(name), width) if width > 1
                     else F.array(F.coalesce(F.col(name).cast("double"), F.lit(0.0))))
    return inputs.withColumn("fusion_vector", F.concat(*parts))


def fuse(inputs: DataFrame, weights, bias) -> DataFrame:
    """Fusion score: needs one vision modality; agreement against the mean of the scored heads."""
    d = fusion_vector(inputs)
    any_vision = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("vit_present", "clip_present")),
                     F.coalesce(F.col("enet_present"), F.lit(0.0))) > 0
    d = d.withColumn("_h", F.when(any_vision, head(F.col("fusion_vector"), weights, bias, FUSION_DIM)))
    heads = F.array_compact(F.array("enet_auth", "vit_auth"))
    mean = F.when(F.size(heads) > 0, F.aggregate(heads, F.lit(0.0), lambda a, x: a + x) / F.size(heads))
    d = d.withColumns({
        "fusion_status": F.when(F.col("_h").isNotNull(), F.lit("FUSED")).otherwise(F.lit("NOT_ASSESSED")),
        "fusion_authentic": F.col("_h.authentic"), "fusion_tampered": F.col("_h.tampered"),
        "_gap": F.abs(mean - F.col("_h.authentic")),
    })
    return d.withColumn("head_agreement", case(
        (F.col("_gap").isNull(), "NOT_ASSESSED"), (F.col("_gap") < 0.15, "AGREE"),
        (F.col("_gap") < 0.3, "PARTIAL"), otherwise="DIVERGE")).drop("_h", "_gap")


def logit(p: Column) -> Column:
    return let(clip(p, EPS, 1.0 - EPS), lambda q: F.ln(q / (1.0 - q)))


def calibrate(d: DataFrame, a: float, b: float) -> DataFrame:
    """Platt scaling sigmoid(a * logit(p) + b), increasing for a > 0.

    Skipped for insufficient quality or an INCONCLUSIVE prior decision.
    """
    skip = (F.col("prior_decision") == "INCONCLUSIVE") | ~F.col("quality_ok")
    fused = (F.col("fusion_status") == "FUSED") & F.col("fusion_authentic").isNotNull()
    est = 1.0 / (1.0 + F.exp(-(F.lit(a) * logit(F.col("fusion_authentic")) + F.lit(b))))
    return d.withColumns({
        "calibration_status": case((skip, "SKIPPED"), (~fused, "NOT_ASSESSED"), otherwise="CALIBRATED"),
        "authenticity_estimate": F.when(~skip & fused, r(est)),
    })


# --- training -----------------------------------------------------------------------

def train(rows: DataFrame, features: str = "features", label: str = "label", normalize: bool = False,
          max_iter: int = 100, reg: float = 0.0):
    """Softmax regression (L-BFGS). ``normalize`` trains on unit vectors, as the heads score them."""
    vec = F.col(features).cast("array<double>")
    data = rows.select(array_to_vector(v.l2(vec) if normalize else vec).alias("features"),
                       F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(data)


def weights_table(spark: SparkSession, model, name: str, version: str = "1") -> DataFrame:
    """Long table (model, version, class, idx, weight); the bias has idx -1."""
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(name, version, k, j, float(x)) for k, row in enumerate(w) for j, x in enumerate(row)]
    rows += [(name, version, k, -1, float(x)) for k, x in enumerate(b)]
    return spark.createDataFrame(rows, "model string, version string, class int, idx int, weight double")


def read_weights(table: DataFrame, name: str, version: str = "1") -> tuple[list[list[float]], list[float]]:
    """Weights and bias of one stored model: classes x dimension values, bounded by the model."""
    rows = table.filter((F.col("model") == name) & (F.col("version") == version)).groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("w")).orderBy("class").collect()
    weights = [[x["weight"] for x in row["w"] if x["idx"] >= 0] for row in rows]
    bias = [x["weight"] for row in rows for x in row["w"] if x["idx"] == -1]
    return weights, bias


def fit_platt(scored: DataFrame, probability: str, is_authentic: str) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(p) + b) for P(authentic)."""
    data = scored.select(array_to_vector(F.array(logit(F.col(probability)))).alias("features"),
                         F.col(is_authentic).cast("double").alias("label"))
    m = LogisticRegression(family="binomial").fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def perturbed(rows: DataFrame, key: str, vec: str, copies: int, scale: float, seed: int = 7) -> DataFrame:
    """Training rows: each given vector ``copies`` times with repeatable normal-like noise."""
    noise = F.transform(F.col(vec).cast("array<double>"), lambda x, i: x + F.lit(scale) * (
        F.pmod(F.xxhash64(F.col(key), F.col("copy"), i, F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1.0))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(
        "features", noise)
