"""Ordered per-key operators that stay spread when one key holds much of the data.

A window over a whole key puts that key in one task. These operators cut every
key into ranges of its order column (``bucket``), work inside the ranges, and
carry only one summary row per range across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank", salts: int = 64, salt_on: Column | None = None) -> DataFrame:
    """Exact first ``k`` rows per key: first k within each salt, then k of those.

    ``order`` must be total within a key so that the choice is repeatable.
    """
    salt = F.pmod(F.xxhash64(*([salt_on] if salt_on is not None else list(df.columns))), F.lit(salts))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)
        .drop("_salt")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, by partial aggregation (no sort)."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key, by partial aggregation (no sort)."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Column, by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


SAMPLE = 4_096


def ranges(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> Column:
    """Number of the range that a row's ``order`` falls into, in ranges that hold about equally many rows.

    Borders are taken from a sample of at most SAMPLE rows, those with the least hashes, so that a minute that holds
    half of the rows is half of the ranges. ``order`` should tell rows apart: rows with equal order stay together. The
    borders decide how work is spread, never what comes out.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    seen = df.select(at.alias("at")).orderBy(F.xxhash64("at")).limit(SAMPLE)
    sample = seen.agg(F.sort_array(F.collect_list("at")).alias("all")).first()["all"]
    borders = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
    if not borders:
        return F.lit(0)
    kinds = [f.dataType for f in seen.schema["at"].dataType.fields]
    known = F.array(*[F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(b, kinds, strict=True))]) for b in borders])
    return F.size(F.filter(known, lambda b: b <= at))


def lag_in_order(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                 bucket: Column | None = None, prefix: str = "prev_") -> DataFrame:
    """Previous row's ``values`` per key in ``order``.

    ``bucket`` must not decrease with ``order``; by default it is one of ``ranges``. The last row of every bucket is
    carried to the next bucket of the key; within a bucket it is a plain lag.
    """
    bucket = ranges(df, [F.col(order)]) if bucket is None else bucket
    payload = F.struct(*[F.col(v) for v in values])
    keyed = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(order)
    ends = keyed.groupBy(*keys, "_bucket").agg(F.max_by(payload, order).alias("_end"))
    carried = ends.select(
        *keys, "_bucket",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
    )
    joined = keyed.withColumn("_local", F.lag(payload).over(local)).join(
        carried, [*keys, "_bucket"], "left"
    )
    prev = F.coalesce("_local", "_carry")
    return joined.select(*df.columns, *[prev[v].alias(prefix + v) for v in values])


def number_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column | None = None,
                    name: str = "seq") -> DataFrame:
    """1-based row number per key: rows of earlier buckets (by default of ``ranges``) plus the place in the own one."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    bucket = ranges(df, order) if bucket is None else bucket
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        keyed.withColumn("_place", place).join(offsets, [*keys, "_bucket"])
        .select(*df.columns, (F.col("_offset") + F.col("_place")).alias(name))
    )
