"""Dense vectors as ARRAY<DOUBLE> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idsieve.functions.common import let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(norm(v) + 1e-12, lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def face_cosine(a: Column, b: Column) -> Column:
    return dot(doubles(a), doubles(b)) / ((norm(doubles(a)) + 1e-8) * (norm(doubles(b)) + 1e-8))


def pad(v: Column, n: int) -> Column:
    """First ``n`` values, filled with zeros; null counts as empty."""
    base = F.coalesce(v.cast("array<double>"), F.array().cast("array<double>"))
    return F.slice(F.concat(base, F.array_repeat(F.lit(0.0), n)), 1, n)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Stable softmax over an array."""
    z = let(scores, lambda s: let(F.array_max(s), lambda m: F.transform(
        s, lambda x: F.exp((x - m) / temperature))))
    return let(z, lambda e: let(_sum(e), lambda t: F.transform(e, lambda x: x / t)))


def summary(v: Column, keep: int = 12) -> Column:
    """struct(dim, norm, mean, std, fingerprint): population std, unit-vector head at 6 digits."""
    return let(v, lambda a: let(F.struct(
        norm(a).alias("n"), (_sum(a) / F.size(a)).alias("m")), lambda s: F.struct(
        F.size(a).alias("dim"), F.round(s["n"], 6).alias("norm"), F.round(s["m"], 6).alias("mean"),
        F.round(F.sqrt(_sum(F.transform(a, lambda x: (x - s["m"]) * (x - s["m"]))) / F.size(a)), 6).alias("std"),
        F.transform(F.slice(a, 1, keep), lambda x: F.round(x / (s["n"] + 1e-12), 6)).alias("fingerprint"))))


def vector_id(v: Column) -> Column:
    """16 hex digits over the values at 6 digits; this text form is our own and stable."""
    text = F.array_join(F.transform(doubles(v), lambda x: F.format_string("%.6f", x)), ",")
    return F.left(F.sha2(text, 256), F.lit(16))
