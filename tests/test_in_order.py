"""Rows that wait for the watermark: few state writes for sparse keys, slots of their own for dense ones."""

import numpy as np
import pandas as pd
import pytest

from idsieve.streaming.in_order import SMALL, InOrder


class Pending(dict):
    writes = 0

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]

    def keys(self):
        return list(super().keys())


class Handle:
    def __init__(self):
        self.timers, self.map = set(), Pending()

    def getMapState(self, name, key, value):
        return self.map

    def registerTimer(self, ms):
        self.timers.add(ms)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


class Seen(InOrder):
    def step(self, key, pdf):
        yield pdf


def _run(chunks, marks):
    """Rows in the order in which they are handed over; after each chunk the watermark of ``marks``."""
    handle, machine, got = Handle(), Seen(1_000), []
    machine.init(handle)
    for chunk, mark in zip(chunks, marks, strict=True):
        list(machine.handleInputRows(("k",), iter([chunk]), None))
        for t in sorted(x for x in handle.timers if x <= mark):
            handle.timers.discard(t)
            got += [x for pdf in machine.handleExpiredTimer(("k",), Times(mark), Times(t)) for x in pdf["ts_us"]]
    return got, handle


def test_sparse_rows_share_pieces():
    ts = np.random.default_rng(1).permutation(200) * 1_000_000
    got, handle = _run([pd.DataFrame({"ts_us": ts})], [1_000_000])
    assert got == sorted(ts.tolist()) and not handle.map
    assert handle.map.writes <= 2, "200 slots, one write for each page"


@pytest.mark.parametrize("dense", [False, True])
def test_late_chunks_and_cut_pages(dense):
    rng = np.random.default_rng(2)
    rows = SMALL + 500 if dense else 300
    one = pd.DataFrame({"ts_us": rng.integers(0, 600_000_000, rows)})
    two = pd.DataFrame({"ts_us": rng.integers(250_000_000, 900_000_000, 100)})
    got, handle = _run([one, two, two.head(0)], [250_000, 610_500, 2_000_000])
    assert got == sorted([*one["ts_us"], *two["ts_us"]]) and not handle.map
