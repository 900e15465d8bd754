"""Trained weights as versioned tables: fit only if there is no version yet, read back, and score by matrix products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from idsieve.functions.common import case, let, r
from idsieve.operators import models

WEIGHTS = "model string, version int, class int, idx int, weight double"


@dataclass(frozen=True)
class Model:
    name: str
    version: int
    weights: list[list[float]]
    bias: list[float]


def stored_weights(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all models under ``path``; no rows where nothing was saved yet."""
    try:
        return spark.read.schema(WEIGHTS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], WEIGHTS)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(model, version, classes, dim) of what is stored."""
    return stored_weights(spark, path).groupBy("model", "version").agg(
        (F.max("class") + 1).alias("classes"), (F.max("idx") + 1).alias("dim"))


def save(spark: SparkSession, path: str, fitted, name: str, version: int) -> None:
    """Write a fitted model as a new version in a folder of its own; a version that is there already is an error."""
    table = models.weights_table(spark, fitted, name).withColumn("version", F.lit(version)).drop("model", "version")
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/model={name}/version={version}")


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> Model | None:
    """One version, by default the newest; None where there is none. What comes to the driver is one model's weights."""
    table = stored_weights(spark, path).filter(F.col("model") == name)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    if version is None:
        return None
    weights, bias = models.read_weights(table, name, version)
    return Model(name, version, weights, bias) if weights else None


def load_or_fit(spark: SparkSession, path: str, name: str, fit: Callable[[], object]) -> Model:
    """The newest stored version; where there is none ``fit`` is called once and saved as version 1."""
    known = load(spark, path, name)
    if known is None:
        save(spark, path, fit(), name, 1)
        known = load(spark, path, name)
    return known


def refit(spark: SparkSession, path: str, name: str, fit: Callable[[], object]) -> Model:
    """Fit anew and save as the version after the newest one; older versions stay."""
    known = load(spark, path, name)
    save(spark, path, fit(), name, known.version + 1 if known else 1)
    return load(spark, path, name)


PROBABILITIES = T.ArrayType(T.DoubleType())


def probabilities(vec: Column, model: Model, unit: bool = False) -> Column:
    """Softmax of the linear scores, by one matrix product per Arrow batch; null for a vector of another length or with a gap.

    ``unit`` scores the vector divided by its length, as heads are trained.
    """
    w, b = np.array(model.weights).T, np.array(model.bias)

    def run(vectors: pa.Array) -> pa.Array:
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        valid = ~vectors.is_null().to_numpy(zero_copy_only=False)
        fits = valid & (sizes == len(w))
        # Null lists hold no values in the flattened array, so places count valid rows only.
        ends = np.cumsum(np.where(valid, sizes, 0))
        at = (ends - len(w))[fits]
        x = flat[at[:, None] + np.arange(len(w))] if len(at) else np.zeros((0, len(w)))
        whole = ~np.isnan(x).any(axis=1)
        if unit:
            x = x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = e / e.sum(axis=1, keepdims=True) if len(e) else e
        out: list = [None] * len(vectors)
        for i, row, ok in zip(np.flatnonzero(fits).tolist(), p.tolist(), whole.tolist(), strict=True):
            out[i] = row if ok else None
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, PROBABILITIES)(vec)


def head(vec: Column, model: Model) -> Column:
    """``models.head`` by matrix products: struct(status, authentic, tampered, label) of a two-class model."""
    return let(probabilities(vec, model, unit=True), lambda p: F.struct(
        F.when(p.isNotNull(), F.lit("SCORED")).otherwise(F.lit("NOT_ASSESSED")).alias("status"),
        r(p[0]).alias("authentic"), r(p[1]).alias("tampered"),
        case((p[0] >= p[1], "authentic"), (p[0] < p[1], "tampered")).alias("label")))
