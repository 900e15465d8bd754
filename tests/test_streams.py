"""Ordered streams against plain state machines: shuffled small batches, restarts, late rows, state that ends."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from idsieve.streaming import in_order, rate_limit as rl, sessions as ss

HITS = "client string, hit_id long, ts_us long"
SECOND = 1_000_000


class Feed:
    """A folder of small files, read one per batch; every call of ``run`` goes on from the checkpoint."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n, self.progress = spark, path, schema, make, 0, []

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        with in_order.rocks(self.spark):
            q = (self.make(source).writeStream.format("parquet").option("path", str(self.path / "out"))
                 .option("checkpointLocation", str(self.path / "cp")).outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
        self.progress += q.recentProgress
        return self.spark.read.parquet(str(self.path / "out")).collect()


def hits(n=240, late=6):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.5 else f"u{rnd.randrange(4)}", i, (100 + rnd.randrange(900)) * SECOND // 2) for i in range(n)]
    return sorted(rows, key=lambda h: h[2] + rnd.uniform(0, late) * SECOND)


def decided(rows, limit, us):
    out, taken = {}, {}
    for client, hid, t in sorted(rows, key=lambda h: (h[0], h[2], h[1])):
        out[hid] = rl.admit([t], taken.setdefault(client, deque()), limit, us)[0] if limit else True
    return out


@pytest.mark.parametrize("limit", [2, 0])
def test_limiter_in_order(spark, tmp_path, limit):
    rows = hits()
    feed = Feed(spark, tmp_path, HITS, lambda s: rl.rate_limit_in_order(s, limit, 20, "8 seconds", 1_000))
    for k in range(0, len(rows), 60):
        feed.put(rows[k:k + 60])
        if k == 60:
            feed.run()  # the rest comes after a restart
    feed.put([("beat", -1, 10_000 * SECOND)])
    got = {r.hit_id: r.admitted for r in feed.run() if r.client != "beat"}
    assert got == decided(rows, limit, 20 * SECOND)
    feed.put([("beat", -2, 20_000 * SECOND), ("u1", -3, 3 * SECOND)])  # the second is behind the watermark
    assert -3 not in {r.hit_id for r in feed.run()}
    feed.put([("beat", -4, 30_000 * SECOND)])
    feed.run()
    left = feed.progress[-1].stateOperators[0].customMetrics
    assert left["numRegisteredTimers"] - left["numDeletedTimers"] - left["numExpiredTimers"] <= 3
    assert feed.progress[-1].stateOperators[0].numRowsTotal <= 8  # what belongs to the last beat


def plain_sessions(events, ttl):
    out, live = [], {}
    rank = {k: i for i, k in enumerate(ss.KINDS)}
    for e in sorted(events, key=lambda e: (e["ts_us"], rank[e["kind"]], e["event_id"])):
        sid, kind = e["session_id"], e["kind"]
        s = live.get(sid)
        if s and e["ts_us"] - s["created"] > ttl:
            out.append((sid, None, s["created"] + ttl, "expire", "EXPIRED", s["case"], s["n"], None, None, None))
            s = live.pop(sid) and None
        seen = face = None
        if kind == "open":
            s = live[sid] = {"created": e["ts_us"], "case": e["case_id"], "n": 0, "gray": None, "face": None}
            status = "READY"
        elif s is None:
            status = "SESSION_NOT_FOUND" if kind == "capture" else "NOT_FOUND"
        elif kind == "attach":
            s["face"], status = (e["doc_count"], e["doc_embedding"], e["doc_label"], e["doc_sha"]), "ATTACHED"
        elif kind == "capture":
            s["n"], seen, s["gray"], face, status = s["n"] + 1, s["gray"], e["gray"], s["face"], "CAPTURED"
        else:
            status = "CLOSED"
        out.append((sid, e["event_id"], e["ts_us"], kind, status, *((s["case"], s["n"], s["face"] is not None) if s else (None,) * 3),
                    seen, face))
        if status == "CLOSED":
            del live[sid]
    out += [(sid, None, s["created"] + ttl, "expire", "EXPIRED", s["case"], s["n"], None, None, None) for sid, s in live.items()]
    return out


EVENTS = ("session_id string, event_id long, ts_us long, kind string, case_id string, gray array<double>, "
          "doc_count long, doc_embedding array<double>, doc_label string, doc_sha string")


def session_events(n=260):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        kind = rnd.choices(ss.KINDS, [2, 1, 6, 1])[0]
        doc = (1 + i % 2, [0.5, i / n, 1.0], "GOOD", f"sha{i}") if kind == "attach" else (None,) * 4
        if kind == "attach" and i % 3 == 0:
            doc = (0, None, None, None)
        gray = [float((i * 7 + k * 13) % 256) for k in range(6)] if kind == "capture" and i % 9 else None
        rows.append(dict(zip([c.split(" ")[0] for c in EVENTS.split(", ")], (
            f"s{rnd.randrange(4)}", i, (100 + rnd.randrange(600)) * SECOND // 2, kind, f"c{i}" if kind == "open" else None, gray, *doc), strict=True)))
    return sorted(rows, key=lambda e: e["ts_us"] + rnd.uniform(0, 5) * SECOND)


def test_sessions(spark, tmp_path):
    rows = session_events()
    feed = Feed(spark, tmp_path, EVENTS, lambda s: ss.session_stream(s, 25, "7 seconds", 2_000))
    for k in range(0, len(rows), 52):
        feed.put([tuple(e.values()) for e in rows[k:k + 52]])
        if k == 104:
            feed.run()
    feed.put([("beat", -1, 5_000 * SECOND, "close", *(None,) * 6)])
    face = lambda r: None if r.doc_count is None else (r.doc_count, r.doc_embedding, r.doc_label, r.doc_sha)
    got = [(r.session_id, r.event_id, r.ts_us, r.kind, r.status, r.case_id, r.captures, r.document_attached, r.prev_gray, face(r))
           for r in feed.run() if r.session_id != "beat"]
    want = plain_sessions(rows, 25 * SECOND)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"EXPIRED", "CLOSED", "NOT_FOUND", "SESSION_NOT_FOUND", "ATTACHED"} <= {g[4] for g in got}
    feed.put([("beat", -2, 9_000 * SECOND, "close", *(None,) * 6)])
    feed.run()
    assert feed.progress[-1].stateOperators[0].numRowsTotal <= 4


def test_frames_of_a_session_log(spark):
    log = spark.createDataFrame([("s", 1, 10, "capture", "CAPTURED", None, 1, True, None, 1, [1.0, 0.0], "GOOD", "a"),
                                 ("s", 2, 20, "capture", "CAPTURED", None, 2, True, [10.0, 20.0], 1, [1.0, 0.0], "GOOD", "a"),
                                 ("s", 3, 30, "close", "CLOSED", None, 2, True, None, None, None, None, None)], ss.LOG)
    frames = spark.createDataFrame(
        [(i, [50.0, 60.0], "live_camera", 1, 400.0, 0.1, 0.01, 0.2, [100.0, 100.0, 100.0], 1, ([1.0, 0.01], "GOOD", "b")) for i in (1, 2)],
        "event_id long, gray array<double>, source string, face_count long, flat_lap double, moire double, specular_frac double, area_fraction double, "
        "channel_means array<double>, live_count long, live struct<embedding: array<double>, face_label: string, image_sha: string>")
    out = {r.event_id: r for r in ss.frame_stream(log, frames).collect()}
    assert set(out) == {1, 2} and out[1].motion is None and out[2].motion == 1.0
    assert {r.cmp_result for r in out.values()} == {"MATCH"} and {r.pad_decision for r in out.values()} == {"PASSIVE_OK_UNCALIBRATED"}


def test_packed_rows_come_back():
    import numpy as np
    import pandas as pd

    pdf = pd.DataFrame({"a": [1, 2], "g": [np.array([1.0, 2.0]), None], "s": ["x", None]})
    back = in_order.unpacked(in_order.packed(pdf)).to_pandas()
    assert back["a"].tolist() == [1, 2] and back["g"][0].tolist() == [1.0, 2.0] and back["g"][1] is None and back["s"][1] is None


def test_rocks_restores_the_setting(spark):
    before = spark.conf.get(in_order.PROVIDER, None)
    with pytest.raises(ValueError), in_order.rocks(spark):
        assert spark.conf.get(in_order.PROVIDER) == in_order.ROCKS
        raise ValueError
    assert spark.conf.get(in_order.PROVIDER, None) == before and F is not None
