"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. In round ``v`` each queue has been credited ``v`` times its target
share and has sent the whole tokens of that credit; the fraction left is its deficit, carried on. A
window of ``length`` tokens closes whenever the queues together have sent that many, so every window
holds the target proportions up to one token a queue, until a queue is empty and the others go on.

The state after ``w`` windows is a closed form of ``w`` alone (the round at which the queues have
sent ``w * length`` tokens). So no task needs an earlier one's result: each computes the state at the
windows its own documents fall into, deficits included. Documents are tokenized once into a table in
the shared folder; a document's place in its queue is the sum of what tasks before it wrote for the
same source, plus its place in its own task.

Defined results: a null text is empty and gives the end id alone; a null source is a queue of its
own; repeated rows are packed each on its own; a document of any length is cut at window ends and
nothing is dropped; only the very last sequence may be padded; an empty table gives no piece; columns
other than key, text and source stay out.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsieve.llm.shared import written
from idsieve.llm.tokens import PATTERN, STRANGE, blocks, byte_letters


@dataclass(frozen=True)
class Packing:
    length: int = 2048
    end_id: int = 1
    #: Sources beyond this many share queues by hash, so that the schedule stays this wide.
    max_queues: int = 512


class Encoder:
    """Ids of whole texts as the tokenizer library gives them, by a faster engine where both are known to agree."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.strange, self.path, self.library = regex.compile(STRANGE), path, None
        self.width = np.dtype("<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if not self.strange.search(text):
            return np.array(self.engine.encode(text, allowed_special="all"), dtype=self.width)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.width)


def tokenized(docs: DataFrame, vocabulary: str, how: Packing, key: str) -> DataFrame:
    """Shared table of (key, source, part, at, n, width, ids): ``at`` counts a task's earlier tokens of that source."""

    def run(batches):
        encode, part, sent = Encoder(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([how.end_id], dtype=encode.width)
        for b in batches:
            texts, sources = [t or "" for t in b.column(2).to_pylist()], b.column(1).to_pylist()
            for i, j in blocks(texts):
                at, n, ids = [], [], []
                for t, s in zip(texts[i:j], sources[i:j], strict=True):
                    x = np.concatenate([encode(t), end])
                    at.append(sent.get(s, 0))
                    n.append(len(x))
                    ids.append(x.tobytes())
                    sent[s] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([part] * (j - i), pa.int32()),
                     pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([encode.width.itemsize] * (j - i), pa.int32()),
                     pa.array(ids, pa.binary())], ["key", "source", "part", "at", "n", "width", "ids"])

    d = docs.select(F.col(key).alias("key"), F.col("source").cast("string").alias("source"), "text")
    kind = d.schema["key"].dataType.simpleString()
    return written(d.mapInArrow(run, f"key {kind}, source string, part int, at long, n long, width int, ids binary"), "tokens")


class Schedule:
    """What each queue has sent after any number of windows."""

    def __init__(self, sizes: np.ndarray, shares: np.ndarray, length: int):
        self.sizes, self.shares, self.length = sizes, shares, length
        self.total = int(sizes.sum())
        self.windows = -(-self.total // length)
        self.last = float(np.max((sizes + 1) / shares)) if len(sizes) else 0.0

    def credit(self, v: np.ndarray) -> np.ndarray:
        return np.minimum(self.sizes, np.floor(v[:, None] * self.shares).astype(np.int64))

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """Row per window number: tokens sent by each queue before that window begins."""
        goal = np.minimum(np.asarray(windows, dtype=np.int64) * self.length, self.total)
        low, high = np.zeros(len(goal)), np.full(len(goal), self.last)
        for _ in range(80):  # halving ends at neighbouring numbers
            mid = (low + high) / 2
            below = self.credit(mid).sum(1) <= goal
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        out, more = self.credit(low), self.credit(high)
        left = goal - out.sum(1)
        # Queues whose next token falls due in the same round send in order until the window is full.
        due = (more > out).astype(np.int64)
        out += due * (np.cumsum(due, 1) <= left[:, None])
        out[goal == self.total] = self.sizes
        return out

    def near(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A window within one of that in which a queue's token is sent."""
        v = (place + 1) / self.shares[queue]
        return self.credit(v).sum(1) // self.length


def pack(docs: DataFrame, vocabulary: str, how: Packing = Packing(), key: str = "doc_id",
         shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``shares`` are the target proportions by source; sources left out, and all by default, are due
    in proportion to their tokens, so that all queues end together.
    """
    t = tokenized(docs, vocabulary, how, key)
    sums = t.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sources = sums.select("source").distinct().count()
    # Up to max_queues sources have a queue each, named by the source itself; more share queues by hash.
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    if sources > how.max_queues:
        queue = F.pmod(F.xxhash64("source"), F.lit(how.max_queues)).cast("string")
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(
        sums.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
        .select("part", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("name"), "queue", "base", "n"), "bases")
    totals = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    sizes = np.array([totals[q] for q in names], dtype=np.int64)
    wanted = {f"={k}": v for k, v in (shares or {}).items()}
    if wanted and sources > how.max_queues:
        raise ValueError(f"shares need a queue for each source: {sources} sources, max_queues is {how.max_queues}")
    known = sum(totals.get(k, 0) for k in wanted)
    plan = Schedule(sizes, np.array([wanted[q] * known / sum(wanted.values()) if q in wanted else totals[q] for q in names], dtype=float),
                    how.length)
    number = {q: i for i, q in enumerate(names)}

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from pieces(b, plan, number)

    placed = (
        t.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
        .join(bases.select("part", "name", "queue", "base"), ["part", "name"])
        .select("key", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "width", "ids")
    )
    kind = t.schema["key"].dataType.simpleString()
    out = placed.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def pieces(b: pa.RecordBatch, plan: Schedule, number: dict[str, int], rows: int = 2_000):
    """The pieces of a batch's documents, some documents at a time."""
    queue = np.array([number[q] for q in b.column(1).to_pylist()], dtype=np.int64)
    at, n = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
    first = np.maximum(plan.near(queue, at) - 1, 0)
    last = np.minimum(plan.near(queue, at + n - 1) + 3, plan.windows + 1)
    for i in range(0, b.num_rows, rows):
        j = min(i + rows, b.num_rows)
        windows = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(first[i:j], last[i:j], strict=True)]))
        sent = plan.sent(windows)
        # A queue's place in a window follows what the queues before it send there.
        ahead = np.zeros_like(sent)
        ahead[:-1, 1:] = np.cumsum(sent[1:] - sent[:-1], 1)[:, :-1]
        where = dict(zip(windows.tolist(), range(len(windows)), strict=True))
        owner, start, length, crc, seq, off = [], [], [], [], [], []
        for k in range(i, j):
            q, a, size = queue[k], int(at[k]), int(n[k])
            lo, hi = where[int(first[k])], where[int(last[k])]
            edges = sent[lo:hi + 1, q]
            own = np.flatnonzero((edges[:-1] < a + size) & (edges[1:] > a))
            s, e = np.maximum(edges[own], a), np.minimum(edges[own + 1], a + size)
            if int((e - s).sum()) != size:
                raise AssertionError("a document's windows do not hold all of its tokens")
            ids = np.frombuffer(b.column(5)[k].as_buffer(), dtype="<u2" if b.column(4)[k].as_py() == 2 else "<u4").astype("<u4")
            raw = memoryview(ids.tobytes())
            crc += [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip((s - a).tolist(), (e - a).tolist(), strict=True)]
            owner += [k] * len(own)
            start.append(s - a)
            length.append(e - s)
            seq.append(windows[lo + own])
            off.append(ahead[lo + own, q] + s - edges[own])
        take = pa.array(owner, pa.int64())
        flat = [pa.array(np.concatenate(x).astype(np.int64)) for x in (start, length)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), *flat, pa.array(crc, pa.int64()), b.column(3).take(take),
             *[pa.array(np.concatenate(x).astype(np.int64)) for x in (seq, off)]],
            ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
