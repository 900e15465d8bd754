"""Versioned weights: fit once, read back, refit; scores by matrix product equal the column form."""

import pytest
from pyspark.sql import functions as F

from idsieve.operators import model_store as ms, models as om


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([([float(i % 7) - 3 + (i % 2), float(i % 5), 1.0 - i % 3], i % 2) for i in range(60)], "features array<double>, label int")


def test_fit_once_then_load(spark, rows, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def fit():
        calls.append(1)
        return om.train(rows, normalize=True, max_iter=20)

    assert ms.load(spark, path, "head") is None and ms.versions(spark, path).count() == 0
    first = ms.load_or_fit(spark, path, "head", fit)
    assert ms.load_or_fit(spark, path, "head", fit) == first and len(calls) == 1 and first.version == 1
    second = ms.refit(spark, path, "head", lambda: om.train(rows, normalize=True, max_iter=20, reg=0.5))
    assert second.version == 2 and second.weights != first.weights
    assert ms.load(spark, path, "head") == second and ms.load(spark, path, "head", 1) == first and ms.load(spark, path, "other") is None
    assert {(r.model, r.version, r.classes, r.dim) for r in ms.versions(spark, path).collect()} == {("head", 1, 2, 3), ("head", 2, 2, 3)}
    with pytest.raises(Exception, match="exists"):
        ms.save(spark, path, om.train(rows, max_iter=5), "head", 2)


def test_matrix_product_equals_columns(spark):
    model = ms.Model("head", 1, [[1.0, -2.0, 0.5], [0.3, 0.1, -1.0]], [0.2, -0.2])
    data = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, []), (6, [-5.0, 900.0, 2.0]), (7, [1.0, None, 2.0]), (8, [1.0, 1.0, 1.0, 1.0]), (9, [9.0, 2.0, 3.0])]
    d = spark.createDataFrame(data, "id long, x array<double>").repartition(2)
    got = {r.id: r for r in d.select("id", ms.head(F.col("x"), model).alias("h"), om.head(F.col("x"), model.weights, model.bias, 3).alias("w")).collect()}
    assert {k for k, r in got.items() if r.h.status == "SCORED"} == {1, 3, 6, 9}
    for k in (1, 3, 6, 9):
        assert (got[k].h.authentic, got[k].h.tampered, got[k].h.label) == (got[k].w.authentic, got[k].w.tampered, got[k].w.label)
    plain = d.select("id", ms.probabilities(F.col("x"), model).alias("p"), om.class_probabilities(F.col("x"), model.weights, model.bias).alias("q")).filter("id in (1, 9)")
    assert all(r.p == pytest.approx(r.q) for r in plain.collect())
    assert d.filter("false").select(ms.probabilities(F.col("x"), model)).count() == 0
