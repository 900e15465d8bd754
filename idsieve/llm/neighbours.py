"""Largest inner products by an inverted-list index with adaptive dimension scans.

Vectors get one more component that gives all of them the same length, so the largest inner product is
the least Euclidean distance. They are turned by a random rotation, after which a few leading
components estimate the whole distance, and put into lists around centroids. Inside a probed list
the components are read in column blocks: after each block a hypothesis test compares the partial
distance, scaled to all components, with the best distances so far, and candidates that are
almost surely farther are abandoned. What is left is scored exactly on the original vectors.

Centroids are fitted on at most ``fit_rows`` vectors picked by hash; every vector is indexed. A list is
split into chunks of about ``chunk`` vectors and its queries likewise, so no task holds a whole list.

Defined results: vectors that are null, zero, empty or hold a null or non-finite component take no part,
as queries or candidates; shorter vectors count as padded with zeros; repeated rows are candidates
each; a query's own id is no candidate, and ties go to the smaller id; fewer candidates than ``k`` are
all returned if the probed lists hold them; an empty table gives an empty result; columns other
than id and vector stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.llm.shared import written


@dataclass(frozen=True)
class Index:
    k: int = 20
    #: Lists probed, nearest first: this factor times a power of the number of lists. The power is below one
    #: because the same share of more and smaller lists finds more of the neighbours.
    probe_factor: float = 1.35
    probe_power: float = 0.84
    fit_rows: int = 16_384
    max_lists: int = 4_096
    chunk: int = 2_048
    block: int = 16  # components read between two tests
    slack: float = 1.5  # of the test, in units of the estimate's spread
    rounds: int = 12
    seed: int = 7

    def probed(self, lists: int) -> int:
        return max(1, min(lists, int(np.ceil(self.probe_factor * lists ** self.probe_power))))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


@dataclass
class Space:
    """Rotation, length and centroids: bounded by ``max_lists`` and the dimension."""

    width: int
    length: float
    turn: np.ndarray
    centroids: np.ndarray

    def matrix(self, column) -> np.ndarray:
        """Original vectors as rows of doubles, padded to ``width``."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.asarray(column.value_lengths())
        out = np.zeros((len(sizes), self.width))
        out[np.arange(self.width) < sizes[:, None]] = flat
        return out

    def candidates(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(1), 0))
        return np.c_[x, rest] @ self.turn

    def queries(self, x: np.ndarray) -> np.ndarray:
        # Scaling a query to the common length changes no order.
        return np.c_[x * (self.length / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros(len(x))] @ self.turn

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids ** 2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit(vectors: DataFrame, how: Index) -> Space | None:
    """Rotation and centroids from (id, vector) rows."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(norm).alias("length")).first()
    if not seen["n"]:
        return None
    lot = F.pmod(F.xxhash64(F.lit("index"), F.col("id")), F.lit(1_000_000_000))
    sample = vectors.filter(lot < int(min(1.0, how.fit_rows / seen["n"]) * 1e9)).select("vector").limit(2 * how.fit_rows).toArrow()
    rng = np.random.default_rng(how.seed)
    turn, _ = np.linalg.qr(rng.standard_normal((seen["width"] + 1, seen["width"] + 1)))
    space = Space(seen["width"], seen["length"] * (1 + 1e-12), turn, np.zeros((1, seen["width"] + 1)))
    x = np.unique(space.candidates(space.matrix(sample.column(0))), axis=0)
    lists = min(how.max_lists, max(1, round(seen["n"] ** 0.5)), len(x)) or 1
    if len(x):
        space.centroids = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(how.rounds):
            own = space.nearest(x, 1)[:, 0]
            sums = np.zeros_like(space.centroids)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=lists)
            space.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], space.centroids)
    return space


def scan(space: Space, how: Index, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray):
    """(query, candidate, score) of the k nearest of one chunk for each query."""
    turned, goal = space.candidates(x), space.queries(q)
    width = turned.shape[1]
    edges = [*range(0, width, how.block), width]
    # Column blocks, each with its rows together.
    columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:])]
    norms, found = (columns[0] ** 2).sum(1), []
    for i in range(0, len(goal), 128):
        g, asked = goal[i:i + 128], query_ids[i:i + 128]
        own = ids[None, :] == asked[:, None]
        limit, head = np.full(len(g), np.inf), turned[:4 * how.k]
        if len(ids) > len(head) > how.k:
            far = (head ** 2).sum(1) + (g ** 2).sum(1)[:, None] - 2 * g @ head.T
            limit = np.partition(np.where(own[:, :len(head)], np.inf, far), how.k - 1, axis=1)[:, how.k - 1]
        # The first block for all pairs at once; later ones only for the pairs that are left.
        part = norms + (g[:, :edges[1]] ** 2).sum(1)[:, None] - 2 * g[:, :edges[1]] @ columns[0].T
        most = lambda b: limit * (1 + 1e-9) if b == width else limit * (b / width) * (1 + how.slack / b ** 0.5) ** 2 + 1e-9
        who, cand = np.nonzero((part <= most(edges[1])[:, None]) & ~own)
        part = part[who, cand]
        for (a, b), c in zip(zip(edges[1:], edges[2:]), columns[1:]):
            part = part + ((c[cand] - g[who, a:b]) ** 2).sum(1)
            keep = part <= most(b)[who] + 1e-9
            who, cand, part = who[keep], cand[keep], part[keep]
        score = np.einsum("ij,ij->i", x[cand], q[i:i + 128][who])
        order = np.lexsort((ids[cand], -score, who))
        who, cand, score = who[order], cand[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < how.k
        found.append((asked[who[best]], ids[cand[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(queries: DataFrame, vectors: DataFrame, how: Index = Index(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of the nearest vectors to each query."""
    pick = lambda d: d.filter(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    base, asked = pick(vectors), pick(queries)
    shape = f"query_id long, rank int, {key} long, score double"
    space = fit(base, how)
    if space is None:
        return vectors.sparkSession.createDataFrame([], shape)
    kind = base.schema["vector"].dataType.simpleString()

    def placed(rows: DataFrame, probes: int, turn: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    s = b.slice(i, 2048)
                    lists = space.nearest(getattr(space, turn)(space.matrix(s.column(1))), probes)
                    at = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.ravel().astype(np.int32)), *[c.take(at) for c in s.columns]], ["list", "id", "vector"])

        return rows.mapInArrow(run, f"list int, id long, vector {kind}")

    members, probing = written(placed(base, 1, "candidates"), "members"), written(placed(asked, how.probed(len(space.centroids)), "queries"), "probing")
    size = lambda d: {r["list"]: r["n"] for r in d.groupBy("list").agg(F.count("*").alias("n")).collect()}  # noqa: E731  max_lists rows
    chunks = lambda sizes: F.array(*[F.lit(-(-sizes.get(i, 0) // how.chunk) or 1) for i in range(len(space.centroids))])
    of_members, of_queries = chunks(size(members)), chunks(size(probing))
    lot = lambda n: F.pmod(F.xxhash64("id"), F.get(n, F.col("list"))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, F.col("list")) - 1))
    left = probing.withColumn("asks", lot(of_queries)).withColumn("chunk", every(of_members))
    right = members.withColumn("chunk", lot(of_members)).withColumn("asks", every(of_queries))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        cols = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if a.num_rows and b.num_rows:
            q, x = space.matrix(a["vector"]), space.matrix(b["vector"])
            order = np.argsort(b["id"].to_numpy(), kind="stable")
            cols = scan(space, how, a["id"].to_numpy(), q, b["id"].to_numpy()[order], x[order])
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), key: pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    groups = ["list", "chunk", "asks"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(run, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= how.k).select("query_id", "rank", key, "score")
