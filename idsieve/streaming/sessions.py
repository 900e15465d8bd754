"""Camera sessions: a fixed life from creation, frames with motion and comparison.

The first functions work on whole tables of sessions and frames. ``session_stream`` is the same as a keyed
state machine over a stream of events of four kinds, with the life of a session ended by a timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from idsieve.operators.identity import compare_faces, motion, pad
from idsieve.operators.ordered import lag_in_order, number_in_order
from idsieve.settings import DEFAULT
from idsieve.streaming.in_order import InOrder, Rows, folded, in_order, lots, unfolded


def live_frames(frames: DataFrame, sessions: DataFrame, ttl_seconds: int = DEFAULT.session_ttl_seconds) -> DataFrame:
    """frames(session_id, ts_us) of sessions(session_id, created_us), with frame_status.

    The life of a session counts from creation, not from its last frame.
    """
    d = frames.join(sessions, "session_id", "left")
    alive = (F.col("ts_us") >= F.col("created_us")) & (F.col("ts_us") - F.col("created_us") <= ttl_seconds * 1_000_000)
    return d.withColumn("frame_status", F.when(F.coalesce(alive, F.lit(False)), F.lit("CAPTURED"))
                        .otherwise(F.lit("SESSION_NOT_FOUND")))


def active_sessions(sessions: DataFrame, now_us: Column, ttl_seconds: int = DEFAULT.session_ttl_seconds) -> DataFrame:
    """Number of sessions alive at ``now_us`` (and not closed)."""
    alive = (F.col("created_us") <= now_us) & (now_us - F.col("created_us") <= ttl_seconds * 1_000_000)
    if "closed_us" in sessions.columns:
        alive = alive & (F.col("closed_us").isNull() | (F.col("closed_us") > now_us))
    return sessions.filter(alive).agg(F.count(F.lit(1)).alias("active_sessions"))


def capture_numbers(frames: DataFrame) -> DataFrame:
    """Capture counter per session, in time order."""
    return number_in_order(frames, ["session_id"], [F.col("ts_us"), F.col("frame_id")], name="captures")


def with_motion(frames: DataFrame) -> DataFrame:
    """Motion of every frame against the previous one of its session; null on the first."""
    d = lag_in_order(frames, ["session_id"], "ts_us", ["gray"])
    return d.withColumn("motion", motion(F.col("prev_gray"), F.col("gray"))).drop("prev_gray")


def frame_results(frames: DataFrame, sessions: DataFrame, ttl_seconds: int = DEFAULT.session_ttl_seconds) -> DataFrame:
    """Cues and one-to-one comparison per live frame against the session's document face.

    frames carry live (face struct) and live_count, sessions doc and doc_count.
    """
    alive = live_frames(frames, sessions, ttl_seconds).filter("frame_status = 'CAPTURED'")
    return compare_faces(pad(with_motion(alive)))


#: Events of one time are taken in this order, then by event_id.
KINDS = ("open", "attach", "capture", "close")
DOC = "doc_count long, doc_embedding array<double>, doc_label string, doc_sha string"
LOG = f"session_id string, event_id long, ts_us long, kind string, status string, case_id string, captures long, document_attached boolean, prev_gray array<double>, {DOC}"


class SessionMachine(InOrder):
    """open starts a life (anew if there is one), attach keeps a document face, capture counts and keeps the gray
    thumbnail for the next one, close ends it. A life also ends ``ttl`` after it began, whatever came in between;
    then the state is dropped and an ``expire`` row is given out. Events without a life find no session.
    """

    keeps = ("ts_us", "data")

    def __init__(self, ttl_seconds: int, slot_ms: int, names: tuple[str, ...]):
        super().__init__(slot_ms)
        self.names, self.by = names, [names.index(c) for c in ("ts_us", "rank", "event_id")]
        self.us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # One value, read once and written once each time a key is woken: the life, the gray thumbnail, the document face.
        self.state = handle.getValueState("session", f"created_us long, case_id string, captures long, gray array<double>, attached boolean, {DOC}")
        self.held, self.ready = None, []

    def _load(self) -> list:
        """[life, gray, face, the creation that is stored]"""
        if self.held is None:
            v = self.state.get()
            self.held = [None, None, None, None] if v is None else [list(v[:3]), v[3], tuple(v[5:]) if v[4] else None, v[0]]
        return self.held

    def step(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from lots(self._steps(key, pdf["data"].tolist()))

    def step_rows(self, key, rows: Rows) -> Iterator[pd.DataFrame]:
        at = rows.names.index("data")
        self.ready = self._steps(key, [r[at] for r in rows.rows])
        yield from ()

    def _steps(self, key, data: list[bytes]) -> list[tuple]:
        life, gray, face, stored = self._load()
        rows = sorted((pickle.loads(x) for x in data), key=lambda r: [(r[i] is None, r[i]) for i in self.by])
        out = []
        for r in rows:
            e = dict(zip(self.names, r, strict=True))
            if life is not None and e["ts_us"] - life[0] > self.us:
                out.append(self._expired(key, life))
                life = gray = face = None
            kind, seen = e["kind"], None
            if kind == "open":
                life, gray, face, status = [int(e["ts_us"]), e["case_id"], 0], None, None, "READY"
            elif life is None:
                status = "SESSION_NOT_FOUND" if kind == "capture" else "NOT_FOUND"
            elif kind == "attach":
                embedding = e["doc_embedding"]
                face = (int(e["doc_count"] or 0), None if embedding is None else [float(x) for x in embedding], e["doc_label"], e["doc_sha"])
                status = "ATTACHED"
            elif kind == "capture":
                life[2] += 1
                seen, status = gray, "CAPTURED"
                gray = None if e["gray"] is None else [float(x) for x in e["gray"]]
            else:
                status = "CLOSED"
            out.append((key[0], None if e["event_id"] is None else int(e["event_id"]), int(e["ts_us"]), kind, status, *self._shown(life, face), seen,
                        *(face if kind == "capture" and face else (None,) * 4)))
            if status == "CLOSED":
                life = gray = face = None
        self.held = [life, gray, face, stored]
        return out

    def settle(self, key, upto_ms: int) -> Iterator[pd.DataFrame]:
        """Ends a life whose time is up, and writes what stays."""
        life, gray, face, stored = self._load()
        out, self.held, self.ready = self.ready, None, []
        if life is not None and life[0] + self.us < upto_ms * 1000:
            out.append(self._expired(key, life))
            life = None
        if life is not None:
            self.state.update((*life, gray, face is not None, *(face or (None,) * 4)))
            if life[0] != stored:
                self.wake(life[0] + self.us)
        elif stored is not None:
            self.state.clear()
        yield from lots(out)

    def _expired(self, key, life) -> tuple:
        return (key[0], None, life[0] + self.us, "expire", "EXPIRED", life[1], life[2], None, None, *(None,) * 4)

    @staticmethod
    def _shown(life, face) -> tuple:
        return (None, None, None) if life is None else (life[1], life[2], face is not None)


def session_stream(events: DataFrame, ttl_seconds: int = DEFAULT.session_ttl_seconds, delay: str = "10 seconds", slot_ms: int = 1_000) -> DataFrame:
    """events(session_id, event_id, ts_us, kind, case_id, gray, doc_count, doc_embedding, doc_label, doc_sha) as a stream -> LOG.

    Captures carry what the state held for them: the gray thumbnail before theirs and the attached document face.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    doc = [c.split(" ")[0] for c in DOC.split(", ")]
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), "event_id", "ts_us", "kind", rank.alias("rank"), "case_id",
                         F.col("gray").cast("array<double>").alias("gray"), *doc)
    machine = SessionMachine(ttl_seconds, slot_ms, tuple(rows.columns))
    return unfolded(in_order(folded(rows, "session_id", "ts_us"), "session_id", machine, "data binary", delay), LOG)


def frame_stream(log: DataFrame, frames: DataFrame) -> DataFrame:
    """Cues and comparison of the captures of a session log; ``frames`` has what each frame measured, by event_id.

    The state only carries what one frame needs of others; the rest meets here, so large measurements never wait in state.
    """
    d = log.filter("kind = 'capture'").drop("kind").withColumnRenamed("status", "frame_status").join(frames, "event_id")
    d = d.withColumn("motion", motion(F.col("prev_gray"), F.col("gray"))).withColumns({
        "doc": F.struct(F.col("doc_embedding").alias("embedding"), F.col("doc_label").alias("face_label"), F.col("doc_sha").alias("image_sha")),
        "doc_count": F.coalesce("doc_count", F.lit(0).cast("long"))})
    return compare_faces(pad(d)).drop("prev_gray", "doc_embedding", "doc_label", "doc_sha")
