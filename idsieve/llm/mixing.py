"""Mixing sources to target weights by Pareto order sampling.

A source that should give ``r`` times its size gets ``floor(r)`` whole copies of every document as
certain, and the fraction ``f`` left by a sample of fixed size: documents are ranked by random odds
``u / (1 - u)`` over inclusion odds ``p / (1 - p)``, and the first ones whose sizes fill the missing
words are taken. ``p`` is the fraction ``f`` of the document's source, so it differs between sources
and is the same for every word of one source. ``u`` is a hash of the document id, so reruns agree.

The cut is found without ordering a source: sizes are summed by fine bins of the rank, bins below
the one where the sum crosses the missing words are taken whole, and only that bin is ordered.

Only DataFrame functions run here. Defined results: a null text has size 0; documents of size 0
take 0; null is a source of its own, last in order; a null id has its own fixed hash; repeated rows
share a rank and stand next to each other; an empty table gives an empty result; all input columns
stay, but a result replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.llm.shared import written
from idsieve.llm.words import held, released

BINS = 65_536
DIGITS = 13  # hexadecimal digits of the hash that make the random number


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by order of source, repeating
    total: float = 1.5  # words of the mix over words there are
    most: float = 2.0  # times its size that a source may give
    cut_last: bool = True  # the last document taken gives only the words still missing; else it is whole or out


def random_unit(key: Column, seed: str = "mix") -> Column:
    """Number in [0, 1) from the digits of a hash of ``key``."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16 ** DIGITS))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``.

    Resharing the excess of stopped sources until none is above ends where a common factor times the
    weight, stopped at the limit, adds up to the whole; sources stop in the order of limit over weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]),
                          ((F.row_number().over(order) - 1) % len(mix.weights) + 1).cast("int"))
    s = s.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * mix.most)
    s = s.withColumn("_stop", F.col("_limit") / F.col("_weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("_stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_all", F.sum("source_size").over(every) * mix.total)
        .withColumn("_stopped", F.coalesce(F.sum("_limit").over(upto), F.lit(0.0)))
        .withColumn("_active", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(upto), F.lit(0.0)))
        # The factor if exactly the sources before this one are stopped; right at the first that is not above it.
        .withColumn("_factor", (F.col("_all") - F.col("_stopped")) / F.col("_active"))
    )
    s = s.withColumn("_factor", F.min(F.when(F.col("_factor") <= F.col("_stop"), F.struct("_stop", "_factor")))
                     .over(every)["_factor"])
    return s.select("source", "source_size", F.least(
        F.col("_limit"), F.coalesce(F.col("_factor") * F.col("_weight"), F.col("_limit"))).alias("target"))


def take(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id") -> DataFrame:
    """``docs`` (with ``source`` and ``size``) and ``source_size``, ``target`` and ``taken``."""
    columns, docs = docs.columns, held(docs, *{key: 0, "source": 0, "size": 0})
    t = targets(docs, mix).withColumn("_same", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    d = docs.withColumn("_same", F.col("source").isNull()).withColumn("_s", F.coalesce("source", F.lit("")))
    t = (
        t.withColumnRenamed("source", "_s")
        .withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_whole", F.floor(F.col("_ratio") + 1e-12))
        .withColumn("_p", F.greatest(F.lit(0.0), F.col("_ratio") - F.col("_whole")))
        .withColumn("_missing", F.greatest(F.lit(0).cast("long"),
                                           F.round("target").cast("long") - F.col("_whole") * F.col("source_size")))
    )
    # One row per source, and one per source below: written, so that their size is known when the joins are planned.
    d = d.join(written(t, "mix-targets"), ["_s", "_same"])
    u = random_unit(F.col(key))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    # Odds grow with u inside a source, so bins of u are bins of the rank.
    d = d.withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * BINS)).withColumn(
        "_odds", F.when(F.col("_p") > 0, odds).otherwise(F.col("_u")))
    run = Window.partitionBy("_s", "_same").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        d.groupBy("_s", "_same", "_bin", "_missing").agg(F.sum("size").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(run), F.lit(0)))
        .filter((F.col("_before") <= F.col("_missing")) & (F.col("_before") + F.col("_in") > F.col("_missing")))
        .select("_s", "_same", F.col("_bin").alias("_edge"), "_before")
    )
    d = d.join(written(bins, "mix-edges"), ["_s", "_same"], "left")
    inside = F.col("_bin") == F.col("_edge")
    rank = Window.partitionBy("_s", "_same").orderBy("_odds", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.filter(inside).withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(rank), F.lit(0)))
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_missing") - F.col("_start")))
    if not mix.cut_last:
        left = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    extra = d.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "_extra", F.when((F.col("_missing") > 0) & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge"))),
                         F.col("size")).otherwise(0))
    both = extra.unionByName(edge.withColumn("_extra", left).drop("_start"))
    return both.withColumn("taken", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long")).transform(
        released, columns, "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS lim, 2.0 * source_size / w AS stop,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS factor
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim, w * (SELECT arg_min(factor, stop) FROM f WHERE factor <= stop))::DOUBLE AS target FROM f),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.u, m.*,
    greatest(0, round(target) - whole * source_size) AS missing,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, missing - before)) AS BIGINT) AS taken
FROM r
"""
