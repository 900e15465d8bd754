"""Sliding-window admission per client.

A hit is admitted when fewer than ``limit`` admitted hits of its client lie
within the last ``window`` seconds; rejected hits are not logged. The rule is
recursive, so it needs state: the times of at most ``limit`` admitted hits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from idsieve.streaming.in_order import InOrder, in_order


def client_key(forwarded: Column, host: Column) -> Column:
    """First forwarded hop, else host, else unknown."""
    hop = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(F.length(forwarded) > 0, hop), F.nullif(host, F.lit("")), F.lit("unknown"))


def admit(times: Iterator[int], taken: deque, limit: int, window_us: int) -> list[bool]:
    """Decide hits in time order; ``taken`` holds admitted times and is updated."""
    out = []
    for t in times:
        while taken and t - taken[0] > window_us:
            taken.popleft()
        ok = len(taken) < limit
        if ok:
            taken.append(t)
        out.append(ok)
    return out


def segments(hits: DataFrame, limit: int, us: int) -> DataFrame:
    """(client, _b, _segment, _warms): the segment of each window-long bucket, and whether its hits also begin the next one.

    Where two buckets in a row hold at most ``limit`` hits, every hit of the second is admitted whatever came
    before, so the state at its end is known from its own hits alone: there a client can be cut. Silence is the
    case of no hits at all. Only a stretch in which a client stays at its limit is decided from its beginning.
    """
    order = Window.partitionBy("client").orderBy("_b")
    used = hits.groupBy("client", "_b").agg(F.count(F.lit(1)).alias("_n"))
    gap = F.col("_b") - F.lag("_b").over(order)
    before = F.when(gap == 1, F.lag("_n").over(order)).otherwise(0)
    calm = before + F.col("_n") <= limit
    d = used.withColumns({"_gap": gap, "_calm": calm})
    after = F.lag("_calm").over(order)
    # A new segment starts after more than a window without hits, or right behind a calm bucket.
    start = F.col("_gap").isNull() | (F.col("_gap") >= 2) | after
    d = d.withColumn("_start", F.coalesce(start, F.lit(True)))
    d = d.withColumn("_segment", F.sum(F.col("_start").cast("int")).over(order))
    follows = F.lead("_start").over(order) & (F.lead("_b").over(order) == F.col("_b") + 1)
    return d.select("client", "_b", "_segment", F.coalesce(F.col("_calm") & follows, F.lit(False)).alias("_warms"))


def rate_limit(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """hits(client, hit_id, ts_us) -> + admitted. Batch form.

    Clients are cut into ``segments``, which spread over the tasks; a segment is read in order, batch by batch,
    with only ``limit`` times held. The hits of a calm bucket (at most ``limit``) come a second time before the next
    segment, to set its state.
    """
    if limit <= 0:
        return hits.withColumn("admitted", F.lit(True))
    us = window_seconds * 1_000_000
    d = hits.withColumn("_b", F.floor(F.col("ts_us") / us))
    keyed = d.join(segments(d, limit, us), ["client", "_b"]).drop("_b")
    warm = keyed.filter("_warms").withColumns({"_segment": F.col("_segment") + 1, "_warm": F.lit(True)})
    keyed = keyed.withColumn("_warm", F.lit(False)).unionByName(warm).drop("_warms")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    names = [*hits.columns, "admitted"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, deque()
        for pdf in batches:
            flags = []
            for key, t in zip(zip(pdf["client"], pdf["_segment"]), pdf["ts_us"]):
                if key != at:
                    at, taken = key, deque()
                flags.extend(admit([t], taken, limit, us))
            yield pdf.assign(admitted=flags)[~pdf["_warm"]][names]

    return (keyed.repartition("client", "_segment").sortWithinPartitions("client", "_segment", "ts_us", "hit_id")
            .mapInPandas(fold, f"{fields}, admitted boolean"))


OUTPUT = "client string, hit_id long, ts_us long, admitted boolean"


class RateLimiter(StatefulProcessor):
    """Streaming form: per client the admitted times of the last window.

    A client's hits of one micro-batch are decided in the order of their times, however many chunks
    bring them; they are held together, so a trigger bounds them. Hits older than a decided batch
    are decided as they come.
    """

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.us = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = deque(self.taken.get()[0] if self.taken.exists() else [])
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "hit_id"], ignore_index=True)
        ok = [True] * len(pdf) if self.limit <= 0 else admit(pdf["ts_us"], taken, self.limit, self.us)
        yield pd.DataFrame({"client": key[0], "hit_id": pdf["hit_id"], "ts_us": pdf["ts_us"], "admitted": ok})
        self.taken.update(([int(t) for t in taken],))

    def close(self) -> None:
        pass


def rate_limit_stream(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """hits(client, hit_id, ts_us) as a stream. Needs the RocksDB state store."""
    return hits.groupBy("client").transformWithStateInPandas(
        RateLimiter(limit, window_seconds), OUTPUT, "Append", "None")


class OrderedLimiter(InOrder):
    """Hits wait for the watermark and are decided in the order of their times; a client silent for a window leaves no state."""

    order = ("ts_us", "hit_id")

    def __init__(self, limit: int, window_seconds: int, slot_ms: int):
        super().__init__(slot_ms)
        self.limit, self.us = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.taken = handle.getValueState("taken", "times array<bigint>")

    def step(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        taken = deque(self.taken.get()[0] if self.taken.exists() else [])
        ok = [True] * len(pdf) if self.limit <= 0 else admit(pdf["ts_us"], taken, self.limit, self.us)
        if taken:
            self.taken.update(([int(t) for t in taken],))
            self.wake(int(taken[-1]) + self.us)
        yield pd.DataFrame({"client": key[0], "hit_id": pdf["hit_id"], "ts_us": pdf["ts_us"], "admitted": ok})

    def settle(self, key, upto_ms: int) -> Iterator[pd.DataFrame]:
        if self.taken.exists() and self.taken.get()[0][-1] + self.us < upto_ms * 1000:
            self.taken.clear()
        yield from ()


def rate_limit_in_order(hits: DataFrame, limit: int, window_seconds: int, delay: str = "10 seconds", slot_ms: int = 1_000) -> DataFrame:
    """hits(client, hit_id, ts_us) as a stream, decided as ``rate_limit`` decides the same rows at once.

    A hit is decided when the watermark, ``delay`` behind the newest hit, has passed its slot.
    """
    return in_order(hits.select("client", "hit_id", "ts_us"), "client", OrderedLimiter(limit, window_seconds, slot_ms), OUTPUT, delay)
