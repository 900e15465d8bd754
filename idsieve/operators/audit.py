"""Tamper-evident audit hash chains.

Verification is parallel: a row's content hash is row-local and links are
compared with a carried lag. Appending is a sequential fold by nature, so there
is one chain per case; rows of a case are streamed through the fold in order
and never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import case
from idsieve.functions.fixed import GENESIS_HASH
from idsieve.operators.ordered import lag_in_order, number_in_order, top_k_per_key
from idsieve.plans.folders import stored


def canonical() -> Column:
    """JSON of the covered values, keys sorted, UTF-8; the timestamp is not covered."""
    return F.to_json(F.struct("action", "actor", "case_id", "summary"))


def entry_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("|"), body), 256)


def summary_text(summary: Column, detail_keys: Column) -> Column:
    """Summary with the sorted detail keys appended, blanks and bars trimmed."""
    keys = F.concat(F.lit("["), F.array_join(F.transform(
        F.array_sort(detail_keys), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    full = F.concat(F.coalesce(summary, F.lit("")), F.lit(" | details_keys="), keys)
    trimmed = F.regexp_replace(full, r"^[ |]+|[ |]+$", "")
    return F.when(F.size(detail_keys) > 0, trimmed).otherwise(F.coalesce(summary, F.lit("")))


def append(events: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """events(id, case_id, action, actor, summary) -> with prev_hash and entry_hash.

    ``tips(case_id, tip)`` continues existing chains. The fold reads each case in
    id order, batch after batch, and keeps only the last hash. Every read of the
    result runs the fold again: store it before steps that read it several times.
    """
    d = events.withColumn("body", canonical())
    if tips is not None:
        d = d.join(tips.select("case_id", "tip"), "case_id", "left")
    else:
        d = d.withColumn("tip", F.lit(None).cast("string"))
    d = d.withColumn("tip", F.coalesce("tip", F.lit(GENESIS_HASH)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]
    schema = ", ".join([*fields, "prev_hash string", "entry_hash string"])
    names = [*events.columns, "prev_hash", "entry_hash"]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, ""
        for pdf in batches:
            prevs, hashes = [], []
            for case_id, body, tip in zip(pdf["case_id"], pdf["body"], pdf["tip"]):
                prev = last if case_id == at else tip
                at, last = case_id, hashlib.sha256(f"{prev}|{body}".encode()).hexdigest()
                prevs.append(prev)
                hashes.append(last)
            yield pdf.assign(prev_hash=prevs, entry_hash=hashes)[names]

    return (d.repartition("case_id").sortWithinPartitions("case_id", "id")
            .mapInPandas(chain, schema))


def links(events: DataFrame, keys: tuple[str, ...] = ("case_id",), bucket_rows: int | None = None) -> DataFrame:
    """Add expected_prev, link_ok, content_ok per row. With no keys it is one chain over all rows."""
    k = list(keys)
    d = events
    if not k:
        d, k = events.withColumn("_chain", F.lit(0)), ["_chain"]
    bucket = F.floor(F.col("id") / bucket_rows) if bucket_rows else None
    d = lag_in_order(d, k, "id", ["entry_hash"], bucket, "_p_")
    expected = F.coalesce("_p_entry_hash", F.lit(GENESIS_HASH))
    return d.withColumn("expected_prev", expected).withColumns({
        "link_ok": F.col("prev_hash") == F.col("expected_prev"),
        "content_ok": F.col("entry_hash") == entry_hash(F.col("prev_hash"), canonical()),
    }).drop("_p_entry_hash", "_chain")


def chain_status(linked: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """VALID or BROKEN per chain, first broken event, rows checked, tip."""
    bad = ~(F.col("link_ok") & F.col("content_ok"))
    agg = [
        F.count(F.lit(1)).alias("checked"), F.min(F.when(bad, F.col("id"))).alias("broken_event"),
        F.max_by("entry_hash", "id").alias("tip_hash"),
    ]
    g = linked.groupBy(*keys).agg(*agg)
    return g.withColumn("chain_status", case(
        (F.col("checked") == 0, "EMPTY"), (F.col("broken_event").isNotNull(), "BROKEN"), otherwise="VALID"))


def verify(events: DataFrame, keys: tuple[str, ...] = ("case_id",), bucket_rows: int | None = None) -> DataFrame:
    return chain_status(links(events, keys, bucket_rows), keys)


def broken_at(linked: DataFrame) -> DataFrame:
    """(case_id, checked, broken_at): place, from 0, of the first event of each case that does not hold; null where all do."""
    # Numbering reads its rows three times, so the checks are made once and kept.
    checked = stored(linked.select("case_id", "id", (~(F.col("link_ok") & F.col("content_ok"))).alias("bad")), "checked")
    placed = number_in_order(checked, ["case_id"], ["id"], name="place")
    return placed.groupBy("case_id").agg(F.count(F.lit(1)).alias("checked"), F.min(F.when(F.col("bad"), F.col("place") - 1)).cast("long").alias("broken_at"))


def by_case(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events of each case in order with their ``rank``: all of them, or a first page of ``limit``."""
    if limit is not None:
        return top_k_per_key(events, ["case_id"], [F.asc("id")], limit)
    return number_in_order(events, ["case_id"], ["id"], name="rank")
