"""Column helpers shared by the scoring expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(c: Column, default: float = 0.0) -> Column:
    """NaN, infinities and nulls become ``default`` (NaN sorts above +inf in Spark)."""
    return F.when(F.abs(c) < F.lit(INF), c).otherwise(F.lit(default))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def clip01(c: Column) -> Column:
    return clip(finite(c), 0.0, 1.0)


def r(c: Column, n: int = 4) -> Column:
    """Round half up; the nudge sends decimal ties up whatever their last binary digit."""
    return F.round(c + F.lit(1e-9), n)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, trimmed; null when nothing matches."""
    return blank_to_null(strip(F.regexp_extract(text, pattern, group)))


def case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """First true condition wins."""
    (cond, value), *rest = branches
    out = F.when(cond, lit(value))
    for cond, value in rest:
        out = out.when(cond, lit(value))
    return out.otherwise(lit(otherwise))


def flags(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted(pairs: dict[str, float], get=F.col) -> Column:
    return add_all([get(name) * F.lit(w) for name, w in pairs.items()])


def let(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` uses it.

    Nested Column functions otherwise copy their argument at each use and the
    expression grows exponentially.
    """
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def fence(c: Column) -> Column:
    """``c`` itself, but filters on it stay above the projection that computes it.

    Catalyst pushes a filter on a computed column down by copying the column's
    whole expression, through every stage below. For a verdict built in many
    stages that copy grows beyond memory, while a filter on it can never reach a
    scan. The partition number is never negative, so the value does not change.
    """
    return F.when(F.spark_partition_id() >= 0, c)
