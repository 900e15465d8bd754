"""A hash tree over the tips of all audit chains, so that a lost case or a lost end of a case shows.

A chain per case proves what is inside of it, not that it is all there. The leaves of the tree are the cases in
their order, each with its last hash and its number of events; a node is the hash of up to ``fan`` nodes below
it. The root goes into an anchor together with the anchor before, so anchors are a chain over all batches. A proof
of membership has, per level, the nodes beside the case's own: enough to come from its tip to the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case
from idsieve.functions.fixed import GENESIS_HASH
from idsieve.operators.ordered import number_in_order
from idsieve.plans.folders import stored

FAN = 256


def leaf_hash(case_id: Column, tip: Column, n: Column) -> Column:
    return F.sha2(F.concat_ws("|", case_id, tip, n.cast("string")), 256)


def leaves(events: DataFrame) -> DataFrame:
    """(case_id, tip, n): last hash and number of events of each case, by partial aggregation."""
    return events.groupBy("case_id").agg(F.max_by("entry_hash", "id").alias("tip"), F.count(F.lit(1)).alias("n"))


def tree(tips: DataFrame, fan: int = FAN) -> DataFrame:
    """(level, idx, hash, case_id, tip, n) of all nodes; level 0 has the cases in their order, the last one the root.

    A level is a grouping of the one below by whole division, so each node collects at most ``fan`` hashes.
    """
    first = number_in_order(tips, [], ["case_id"], name="idx").select(
        F.lit(0).alias("level"), (F.col("idx") - 1).cast("long").alias("idx"),
        leaf_hash(F.col("case_id"), F.col("tip"), F.col("n")).alias("hash"), "case_id", "tip", "n")
    levels = [stored(first, "tree")]
    n = levels[0].count()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("case_id", "string"), ("tip", "string"), ("n", "long"))]
    while n > 1:
        below = levels[-1]
        above = below.groupBy(F.floor(F.col("idx") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("of"))
        above = above.select(F.lit(len(levels)).alias("level"), F.col("up").alias("idx"),
                             F.sha2(F.array_join(F.col("of.hash"), ""), 256).alias("hash"), *none)
        levels.append(stored(above, "tree"))
        n = -(-n // fan)
    return reduce(DataFrame.unionByName, levels)


def anchor(nodes: DataFrame, previous: str = GENESIS_HASH) -> DataFrame:
    """(cases, root, previous, anchor): one row; the root of no case is the genesis hash."""
    top = nodes.agg(F.max_by("hash", "level").alias("root"), F.count_if(F.col("level") == 0).alias("cases"))
    root = F.coalesce("root", F.lit(GENESIS_HASH))
    return top.select("cases", root.alias("root"), F.lit(previous).alias("previous")).withColumn(
        "anchor", F.sha2(F.concat_ws("|", "previous", "root", F.col("cases").cast("string")), 256))


def compared(events: DataFrame, kept: DataFrame) -> DataFrame:
    """(case_id, anchor_status): each case of the events now, or of the leaves ``kept`` (case_id, tip, n) then.

    VALID: as it was. EXTENDED: its kept tip stands where it stood, events came after it. TRUNCATED: its last events are
    gone. REPLACED: other events stand in their place. MISSING: the case is gone. ADDED: it was not there.
    """
    now, then = leaves(events), kept.select("case_id", F.col("tip").alias("kept_tip"), F.col("n").alias("kept_n"))
    known = then.withColumnsRenamed({"kept_tip": "entry_hash"}).select("case_id", "entry_hash")
    still = events.join(known, ["case_id", "entry_hash"], "left_semi").select("case_id").distinct().withColumn("still", F.lit(True))
    d = now.join(then, "case_id", "full_outer").join(still, "case_id", "left")
    return d.select("case_id", case(
        (F.col("n").isNull(), "MISSING"), (F.col("kept_n").isNull(), "ADDED"), ((F.col("tip") == F.col("kept_tip")) & (F.col("n") == F.col("kept_n")), "VALID"),
        (F.coalesce("still", F.lit(False)) & (F.col("n") > F.col("kept_n")), "EXTENDED"), (F.col("n") < F.col("kept_n"), "TRUNCATED"),
        otherwise="REPLACED").alias("anchor_status"))


def proofs(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """(case_id, leaf, proof): per level above the leaf the place of the own node and all nodes of its group.

    Groups are formed once per level and joined by the number of the ancestor; a proof has fan times levels hashes.
    """
    top = nodes.agg(F.max("level")).first()[0] or 0
    out = nodes.filter("level = 0").select("case_id", F.col("hash").alias("leaf"), F.col("idx").alias("_at"), F.array().cast(
        "array<struct<at: long, hashes: array<string>>>").alias("proof"))
    for level in range(top):
        of = nodes.filter(F.col("level") == level).groupBy(F.floor(F.col("idx") / fan).alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("_of"))
        out = out.withColumn("_up", F.floor(F.col("_at") / fan)).join(of, "_up").withColumns({
            "proof": F.array_append("proof", F.struct((F.col("_at") % fan).cast("long").alias("at"), F.col("_of.hash").alias("hashes"))), "_at": F.col("_up")})
        out = out.drop("_of", "_up")
    return out.drop("_at")


def proved_root(leaf: Column, proof: Column) -> Column:
    """The root that a proof leads to from a leaf; null where the own node is not at its place."""
    step = lambda have, s: F.when(F.get(s["hashes"], s["at"].cast("int")) == have, F.sha2(F.array_join(s["hashes"], ""), 256))
    return F.aggregate(proof, leaf, step)
