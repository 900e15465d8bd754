"""Rows of a stream handed to a keyed state machine in the order of their times.

Micro-batches bring rows in any order. Each row waits in state, in a time slot of its key, until the
watermark has passed the end of the slot; a timer then releases the slots' rows, sorted. So the outcome is the
same however the rows were dealt into batches: rows behind the watermark are dropped by Spark, all others count at
their place. One key holds the slots between the newest row and the watermark, and reads one at a time.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# A chunk of at most SMALL rows of a key waits in pages of PAGE slots, a larger one slot by slot.
SMALL, PAGE = 2_000, 1_024
WIDE = "page-"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


def _plain(v):
    """A cell of a frame without what frames do to it: arrays are lists, what is missing is None."""
    return v.tolist() if isinstance(v, np.ndarray) else None if v is pd.NA or v != v else v


class Rows:
    """A few rows of one key as tuples. Frames cost a millisecond each however small they are, and most keys are small."""

    def __init__(self, names: tuple[str, ...], rows: list[tuple]):
        self.names, self.rows = names, rows

    @staticmethod
    def of(pdf: pd.DataFrame, names: tuple[str, ...] | None = None) -> Rows:
        names = tuple(pdf.columns) if names is None else names
        columns = [c.tolist() if c.dtype.kind in "iub" else [_plain(v) for v in c.tolist()] for c in (pdf[n] for n in names)]
        return Rows(names, [*zip(*columns, strict=True)])

    def __len__(self) -> int:
        return len(self.rows)

    def pieces(self, by: str, size: int, page: int) -> list[tuple[int, int, bytes]]:
        """(first slot, last slot, packed rows) of every page of slots."""
        at, found = self.names.index(by), {}
        for r in self.rows:
            if r[at] is not None:  # a row without a time has no place
                found.setdefault(int(r[at] // size) // page, []).append(r)
        return [(int(min(r[at] for r in own) // size), int(max(r[at] for r in own) // size), pickle.dumps((self.names, own), protocol=5))
                for own in found.values()]

    def split(self, by: str, size: int, end: int) -> tuple[Rows, Rows]:
        """Rows of slots before ``end``, and the others."""
        at = self.names.index(by)
        return (Rows(self.names, [r for r in self.rows if r[at] // size < end]), Rows(self.names, [r for r in self.rows if r[at] // size >= end]))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=list(self.names))


class InOrder(StatefulProcessor):
    """Subclasses give ``step``; it gets a key's rows of one slot by ``order``, whose first column is the time in microseconds."""

    order: tuple[str, ...] = ("ts_us",)
    keeps: tuple[str, ...] | None = None  # the columns that wait; all of them by default

    def __init__(self, slot_ms: int):
        self.slot_ms = max(1, slot_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # How far each key has come in this run of the processor: further timers of the same watermark find nothing to do.
        self.settled: dict = {}
        # A piece holds what one chunk brought for the slots from ``first`` to ``last``, so that a late chunk never
        # rewrites what waits already. A large chunk is cut by single slots, a small one into pages of many.
        # A key has a timer for its earliest piece, at least.
        self.pending = handle.getMapState("pending", "first long, last long, piece string", "data binary")

    def _keep(self, chunk: pd.DataFrame | Rows) -> None:
        if len(chunk) <= SMALL:
            rows = chunk if isinstance(chunk, Rows) else Rows.of(chunk, self.keeps)
            found = rows.pieces(self.order[0], self.slot_ms * 1000, PAGE)
        else:
            slots = self._slots(chunk := chunk.reset_index(drop=True) if isinstance(chunk, pd.DataFrame) else chunk.frame())
            found = [(int(slot), int(slot), packed(part)) for slot, part in chunk.groupby(slots, sort=False)]
        for first, last, data in found:
            self.pending.updateValue((first, last, f"{WIDE if len(chunk) <= SMALL else ''}{uuid.uuid4().hex}"), (data,))
        if found:
            self._expect(min(first for first, _, _ in found))

    def _expect(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.slot_ms)

    def _slots(self, pdf: pd.DataFrame) -> pd.Series:
        return pdf[self.order[0]] // (self.slot_ms * 1000)

    def _taken(self, due: list[tuple], others: bool) -> Rows | None:
        """The rows of all small chunks that are due. Where nothing else waits they are read and dropped at once."""
        if not due:
            return None
        if others:
            data = [self.pending.getValue(k)[0] for k in due]
            for k in due:
                self.pending.removeKey(k)
        else:
            data = [v[0] for v in self.pending.values()]
            self.pending.clear()
        found = [pickle.loads(bytes(x)) for x in data]
        return Rows(found[0][0], [r for _, rows in found for r in rows])

    def _take(self, keys: list[tuple]) -> pd.DataFrame:
        data = pa.concat_tables([unpacked(bytes(self.pending.getValue(k)[0])) for k in keys], promote_options="permissive")
        for k in keys:
            self.pending.removeKey(k)
        return data.to_pandas()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self._keep(pdf)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is through, though timers that are set only now would wait for the next batch.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() // self.slot_ms * self.slot_ms)
        if self.settled.get(tuple(key), -1) >= upto:
            return
        end = upto // self.slot_ms  # the first slot that is not through
        waiting = [tuple(k) for k in self.pending.keys()]
        pages = [k for k in waiting if k[0] < end and k[2].startswith(WIDE)]
        single: dict = {}
        for k in waiting:
            if k[0] < end and not k[2].startswith(WIDE):
                single.setdefault(k[0], []).append(k)
        later = [k for k in waiting if k[0] >= end]
        size = self.slot_ms * 1000
        # Pages come from small chunks only, so all of them together are a few rows for each batch.
        few = self._taken(pages, bool(single or later))
        if few is not None:
            few, wait = few.split(self.order[0], size, end)
            self._keep(wait)
        if later:
            self._expect(min(k[0] for k in later))
        for slot in sorted(single):
            pdf = self._take(single[slot])
            if few is not None:
                early, few = few.split(self.order[0], size, slot + 1)
                pdf = pd.concat([early.frame(), pdf]) if len(early) else pdf
            yield from self.step(key, self._sorted(pdf))
        if few is not None and len(few):
            yield from self.step_rows(key, few)
        yield from self.settle(key, upto)
        self.settled[tuple(key)] = upto

    def _sorted(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(list(self.order), kind="stable", ignore_index=True)

    def step(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def step_rows(self, key, rows: Rows) -> Iterator[pd.DataFrame]:
        """``step`` for a few rows in no order; a machine that needs no frame may do without one."""
        yield from self.step(key, self._sorted(rows.frame()))

    def settle(self, key, upto_ms: int) -> Iterator[pd.DataFrame]:
        """Called when all rows before ``upto_ms`` have been handed over."""
        yield from ()

    def wake(self, after_us: int) -> None:
        """Have ``settle`` called once all rows up to this time are through."""
        self.handle.registerTimer((after_us // (self.slot_ms * 1000) + 1) * self.slot_ms)

    def close(self) -> None:
        pass


LOT = 5_000  # rows in one value of a machine's output, at most


def folded(rows: DataFrame, key: str, time: str) -> DataFrame:
    """(key, time, data): the rows as tuples in one value each. What Spark does to the frames of a key grows with their columns."""

    def fold(batches):
        for b in batches:
            lists = [c.to_pylist() for c in b.columns]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column(time), pa.array([pickle.dumps(r, protocol=5) for r in zip(*lists, strict=True)], pa.binary())], [key, time, "data"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(fold, f"{key} {kinds[key]}, {time} {kinds[time]}, data binary")


def lots(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    """Rows as a machine whose output is ``data`` gives them, for ``unfolded``."""
    for i in range(0, len(rows), LOT):
        yield pd.DataFrame({"data": [pickle.dumps(rows[i:i + LOT], protocol=5)]})


def unfolded(out: DataFrame, schema: str) -> DataFrame:
    """The rows of ``lots``."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def unfold(batches):
        rows: list[tuple] = []
        for b in batches:
            for data in b.column("data").to_pylist():
                rows.extend(pickle.loads(data))
                if len(rows) >= LOT:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return out.mapInArrow(unfold, schema)


def in_order(rows: DataFrame, key: str, machine: InOrder, schema: str, delay: str) -> DataFrame:
    """Run ``machine`` per key over a stream with ``ts_us``; rows more than ``delay`` behind the newest may be dropped."""
    timed = rows.withColumn("_ts", F.timestamp_micros(machine.order[0])).withWatermark("_ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(machine, schema, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
