"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of a fingerprint are dealt into partitions, correlated bits together. Two fingerprints that
differ in at most ``radius`` bits differ in at most ``t_i`` bits of some partition ``i`` whenever the
thresholds add up to ``radius - partitions + 1``. Each fingerprint gets thresholds of its own: dynamic
programming picks those with the least estimated candidates, -1 leaving a partition out. It probes every
value within its thresholds, and candidates are verified on all bits.

Candidate counts are estimated from histograms of each partition's halves. Equal fingerprints are one
entry all along. A bucket beyond ``bucket`` entries is not paired up: its members and the fingerprints
that probe it go another, also exact way (radius up to 2): each lists the fingerprints one bit away,
and two are within two bits just when their lists meet, in lists of at most ``bits + 1`` by nature.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; shorter
texts than a shingle are one shingle; repeated rows and copies share an entry; a null id never names a
component unless it has no other; an empty table gives an empty result; columns other than key and
text stay out of the fingerprint step; texts are read whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsieve.functions.common import let
from idsieve.llm.components import components
from idsieve.llm.shared import written
from idsieve.llm.tokens import blocks
from idsieve.llm.words import HOLD, held, released, words

SEED = 42
#: Fixed value: multiplier and shifts of the public 64-bit finaliser that makes further words of a fingerprint.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BIT_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


@dataclass(frozen=True)
class Search:
    words: int = 3
    bits: int = 64
    radius: int = 2
    partitions: int = 3
    bucket: int = 32
    reach: int = 3  # the largest threshold of one partition, plus one


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> list[int]:
    """The fingerprint as signed 64-bit words, lowest bits first."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = bits // 64
    if not w:
        return [0] * count
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(w) - words + 1)
    line, sums, h = memoryview(b" ".join(w)), np.zeros((8 * count, 8), dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 65_536):
        s, e = starts[i:min(i + 65_536, n)], ends[words - 1:][i:i + 65_536] if len(w) >= words else ends[-1:]
        x = np.array([h(line[a:b], SEED) for a, b in zip(s.tolist(), e.tolist())], dtype=np.uint64)
        for k in range(count):
            if k:
                x = x + np.uint64(0x9E3779B97F4A7C15)
                y = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
                y = (y ^ (y >> np.uint64(27))) * np.uint64(MIX[1])
                y ^= y >> np.uint64(31)
            else:
                y = x
            cells = y.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
            sums[8 * k:8 * k + 8] += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ BIT_OF_BYTE
    return np.packbits((2 * sums > n).astype(np.uint8), axis=1, bitorder="little").ravel().view(np.int64).tolist()


def fingerprints(docs: DataFrame, how: Search, key: str) -> DataFrame:
    """(key, p0, p1 ...) of every row."""
    names = [f"p{k}" for k in range(how.bits // 64)]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks([t or "" for t in texts]):
                found = np.array([fingerprint(t, how.words, how.bits) for t in texts[i:j]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(found[:, k]) for k in range(len(names))]], ["key", *names])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(p, T.LongType()) for p in names]])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, schema)


def _bits(b: pa.RecordBatch, first: int, words: int) -> np.ndarray:
    raw = np.stack([b.column(first + k).to_numpy(zero_copy_only=False) for k in range(words)], axis=1)
    return np.unpackbits(np.ascontiguousarray(raw).view(np.uint8), axis=1, bitorder="little")


class Plan:
    """Partitions of the bits, and tables from which candidate counts are estimated."""

    def __init__(self, groups: list[list[int]], radius: int, reach: int):
        self.groups, self.reach = groups, min(reach, radius + 1)
        self.halves = [(g[:len(g) // 2], g[len(g) // 2:]) for g in groups]
        self.units = radius + 1  # of threshold plus one, over all partitions
        self.total = 0
        self.near: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def value(x: np.ndarray, places: list[int]) -> np.ndarray:
        return x[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))

    def tally(self, rows: list[tuple[int, int, int]], total: int) -> None:
        """Histograms as (half, value, n); near[i][side][value, d] counts entries at distance d in that half."""
        self.total, self.near = total, []
        flat = [np.zeros(1 << len(h)) for pair in self.halves for h in pair]
        for half, value, n in rows:
            flat[half][value] = n
        for i, pair in enumerate(self.halves):
            both = []
            for side, places in enumerate(pair):
                hist, cells = flat[2 * i + side], np.arange(1 << len(places))
                both.append(np.stack([
                    sum((hist[cells ^ sum(1 << c for c in flip)] for flip in combinations(range(len(places)), d)), np.zeros(len(cells)))
                    for d in range(self.reach)], axis=1))
            self.near.append(tuple(both))

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """Per row and partition the threshold plus one; they add up to ``units``."""
        n, u = len(x), self.units
        best, choice = np.full((n, u + 1), np.inf), []
        best[:, 0] = 0
        for (a, b), (near_a, near_b), g in zip(self.halves, self.near, self.groups, strict=True):
            in_a, in_b = near_a[self.value(x, a)], near_b[self.value(x, b)]
            cost, probes, seen = [np.zeros(n)], 0, np.zeros(n)
            for d in range(self.reach):
                seen = seen + sum(in_a[:, k] * in_b[:, d - k] for k in range(d + 1)) / max(self.total, 1)
                probes += len(list(combinations(range(len(g)), d)))
                cost.append(seen + probes)
            new, pick = np.full((n, u + 1), np.inf), np.zeros((n, u + 1), dtype=np.int64)
            for s in range(u + 1):
                for c in range(min(s, self.reach) + 1):
                    v = best[:, s - c] + cost[c]
                    better = v < new[:, s]
                    new[better, s], pick[better, s] = v[better], c
            best = new
            choice.append(pick)
        left, out = np.full(n, u), np.zeros((n, len(self.groups)), dtype=np.int64)
        for i in range(len(self.groups) - 1, -1, -1):
            out[:, i] = choice[i][np.arange(n), left]
            left -= out[:, i]
        return out


def deal(corr: np.ndarray, partitions: int, turn: int = 0) -> list[list[int]]:
    """Groups of bits of nearly equal number, each grown from a free bit by those most correlated with it.

    Later turns weigh correlations at random, so that they group the bits anew.
    """
    free, groups = set(range(len(corr))), []
    strength = np.abs(corr - np.diag(np.diag(corr)))
    if turn:
        noise = np.random.default_rng(turn).random(corr.shape)
        strength = (strength + strength.mean()) * (noise + noise.T)
    for k in range(partitions):
        size = -(-len(free) // (partitions - k))
        group = [max(sorted(free), key=lambda i: strength[i, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(free), key=lambda i: strength[i, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(group)
    return groups


def fit(entries: DataFrame, how: Search, total: int, turns: int = 1) -> list[Plan]:
    """Partitions and histograms from all entries; what comes back is bounded by the bits of a fingerprint."""
    words = how.bits // 64
    names = [f"p{k}" for k in range(words)]

    def products(batches):
        sums = np.zeros((how.bits + 1, how.bits + 1))
        for b in batches:
            x = np.c_[_bits(b, 0, words), np.ones(b.num_rows)].astype(np.float32)
            sums += x.T @ x
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["cell", "n"])

    got = entries.select(*names).mapInArrow(products, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((how.bits + 1) ** 2)
    sums[[r["cell"] for r in got]] = [r["n"] for r in got]
    sums = sums.reshape(how.bits + 1, -1) / max(total, 1)
    mean = sums[-1, :-1]
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = (sums[:-1, :-1] - np.outer(mean, mean)) / np.outer(spread, spread)
    plans = [Plan(deal(corr, how.partitions, t), how.radius, how.reach) for t in range(turns)]
    halves = [h for plan in plans for pair in plan.halves for h in pair]

    def histograms(batches):
        counts = [np.zeros(1 << len(h), dtype=np.int64) for h in halves]
        for b in batches:
            x = _bits(b, 0, words)
            for c, h in zip(counts, halves, strict=True):
                c += np.bincount(Plan.value(x, h), minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(at), pa.array(c[at])], ["half", "value", "n"])

    rows = entries.select(*names).mapInArrow(histograms, "half int, value long, n long").groupBy("half", "value").agg(F.sum("n").alias("n")).collect()
    for t, plan in enumerate(plans):
        first = t * 2 * how.partitions
        plan.tally([(r["half"] - first, r["value"], r["n"]) for r in rows if 0 <= r["half"] - first < 2 * how.partitions], total)
    return plans


def signatures(entries: DataFrame, plan: Plan, how: Search, own_only: bool = False, turn: int = 0,
               keep: tuple[str, ...] = ("node",)) -> DataFrame:
    """(bucket, probe, node, p0 ...): each entry once per partition as a member, and once per value that it probes.

    With ``own_only`` a probe of the entry's own value is left out, as its member row stands for both.
    ``keep`` names the long columns that go with every row.
    """
    words = how.bits // 64
    names = [*keep, *[f"p{k}" for k in range(words)]]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = _bits(part, len(keep), words)
                t = plan.thresholds(x)
                rows, buckets, probe = [], [], []
                for k, g in enumerate(plan.groups):
                    own = Plan.value(x, g) | ((turn * how.partitions + k) << 36)
                    rows.append(np.arange(len(x)))
                    buckets.append(own)
                    probe.append(np.zeros(len(x), dtype=bool))
                    for d in range(int(own_only), int(t[:, k].max(initial=0))):
                        who = np.flatnonzero(t[:, k] > d)
                        for flip in combinations(range(len(g)), d):
                            rows.append(who)
                            buckets.append(own[who] ^ sum(1 << c for c in flip))
                            probe.append(np.ones(len(who), dtype=bool))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(buckets)), pa.array(np.concatenate(probe)), *[c.take(at) for c in part.columns]],
                    ["bucket", "probe", *names])

    return entries.select(*names).mapInArrow(run, ", ".join(["bucket long, probe boolean", *[f"{p} long" for p in names]]))


def apart(a: list[Column], b: list[Column]) -> Column:
    """Number of bits in which two fingerprints differ."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def links(entries: DataFrame, how: Search = Search()) -> DataFrame:
    """Edges (a, b) that connect all entries (node, p0) within ``radius`` bits, and hold none farther apart."""
    if how.radius > 2 or how.bits != 64:
        raise ValueError("links of one-word fingerprints are exact up to radius 2")
    total = entries.count()
    plan = fit(entries, how, total)[0]
    rows = written(signatures(entries, plan, how), "signatures")
    index, probes = rows.filter(~F.col("probe")), rows.filter("probe")
    crowded = written(index.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > how.bucket).select("bucket"), "crowded")
    calm = index.join(crowded, "bucket", "left_anti").select("bucket", F.col("node").alias("b"), F.col("p0").alias("q0"))
    near = (
        probes.join(crowded, "bucket", "left_anti").join(calm, "bucket").filter(F.col("node") != F.col("b"))
        .filter(apart([F.col("p0")], [F.col("q0")]) <= how.radius).select(F.col("node").alias("a"), "b")
    )
    busy = rows.join(crowded, "bucket", "left_semi").select("node", "p0").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(64)])
    meet = busy.select("node", "p0", F.explode(flips).alias("flip")).select(F.col("p0").bitwiseXOR(F.col("flip")).alias("mid"), "node", "p0")
    # At most 65 fingerprints are within a bit of any one.
    met = meet.groupBy("mid").agg(F.sort_array(F.collect_list(F.struct("node", "p0"))).alias("of")).filter(F.size("of") > 1)
    first = F.col("of")[0]
    pairs = met.select(first["node"].alias("a"), first["p0"].alias("p0"), F.explode(F.slice("of", 2, F.size("of") - 1)).alias("x"))
    if how.radius == 2:
        crowd = pairs.select("a", F.col("x.node").alias("b"))
    else:
        full = met.select(F.explode("of").alias("x"), "of").select(F.col("x.node").alias("a"), F.col("x.p0").alias("p0"), F.explode("of").alias("y"))
        crowd = full.filter((F.col("a") < F.col("y.node")) & (apart([F.col("p0")], [F.col("y.p0")]) <= how.radius)).select("a", F.col("y.node").alias("b"))
    return near.unionByName(crowd)


def groups(docs: DataFrame, how: Search = Search(), key: str = "doc_id") -> DataFrame:
    """(key, p0, component) of every row: the least key that is reached through links, itself included."""
    prints = written(fingerprints(docs, how, key), "fingerprints")
    entries = written(prints.groupBy("p0").agg(F.min("key").alias("node")), "entries")
    found = components(links(entries.filter(F.col("node").isNotNull()), how))
    named = entries.join(found, "node", "left").select("p0", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "p0").select(F.col("key").alias(key), "p0", "component")


def representatives(docs: DataFrame, how: Search = Search(), key: str = "doc_id") -> DataFrame:
    """One row of each component of ``groups``: the one with the least key, of its rows the least fingerprint.

    Rows without a key stay once per fingerprint where no row with a key is linked to it. A row that is there several
    times stays once.
    """
    found = written(groups(docs, how, key).withColumnRenamed(key, "key").groupBy("key", "p0").agg(
        F.min("component").alias("component"), F.count("*").alias("n")), "groups")
    named = found.filter(F.col("key").eqNullSafe(F.col("component")))
    least = named.groupBy("key", F.when(F.col("key").isNull(), F.col("p0")).alias("apart")).agg(F.min("p0").alias("p0")).drop("apart")
    alone = found.groupBy("key").agg(F.sum("n").alias("n")).filter("n = 1 AND key IS NOT NULL").select("key")
    rows = held(docs, key, "text").withColumnRenamed(key, "key")
    single = rows.join(least.join(alone, "key").select("key"), "key", "left_semi")
    # Only rows that share a key have to be told apart by their fingerprints once more.
    shared = least.join(alone, "key", "left_anti").select(F.col("key").alias("of"), F.col("p0").alias("print"))
    several = rows.join(shared.select("of").distinct(), F.col("key").eqNullSafe(F.col("of")), "left_semi")
    again = fingerprints(several.select(F.struct("key", HOLD).alias("row"), "text"), how, "row").select("key.*", "p0")
    again = again.join(shared, F.col("key").eqNullSafe(F.col("of")) & (F.col("p0") == F.col("print")), "left_semi")
    return released(single.select(HOLD).unionByName(again.dropDuplicates(["key", "p0"]).select(HOLD)), docs.columns)


def shingle_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """(node, shingles): hashes of the distinct shingles of ``text``, in lower case."""
    w = F.transform(words(F.col("text")), lambda x: F.lower(x))

    def cut(a: Column) -> Column:
        n = F.size(a)
        rest = lambda i: [F.get(a, i + k) for k in range(1, words_each)]
        many = F.transform(F.slice(a, 1, n - words_each + 1), lambda x, i: F.xxhash64(x, *rest(i)))
        return F.when(n < words_each, F.array(F.xxhash64(F.array_join(a, " ")))).otherwise(F.array_distinct(many))

    return docs.select("node", let(w, cut).alias("shingles"))


def bitmap(shingles: Column, words: int = 8) -> list[Column]:
    """``words`` longs in which each shingle sets one bit: a bound on what two sets share, without the sets."""
    def word(k: int) -> Column:
        own = F.filter(shingles, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(words - 1)) == k)
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))

    return [word(k).alias(f"m{k}") for k in range(words)]


#: Shingles of a sample that are put last in the order of prefixes. They decide how many pairs are looked at, never which are found.
COMMON = 50_000


def prefixes(sets: DataFrame, similarity: float, common: list[tuple[int, int]]) -> DataFrame:
    """(shingle, node, n, at): of each set of ``n`` shingles the first ones in one order of all shingles.

    They are so many that two sets of the similarity share one of them, whatever the order is. The shingles
    of ``common`` (hash, count) come last, most frequent at the end.
    """
    listed = sorted(common)
    keys, freq = np.array([h for h, _ in listed], dtype=np.int64), np.array([n for _, n in listed], dtype=np.int64)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.minimum(np.searchsorted(keys, v), max(len(keys) - 1, 0))
                weight = np.where(keys[place] == v, freq[place], 0) if len(keys) else np.zeros(len(v), dtype=np.int64)
                order = np.lexsort((v, weight, row))
                at = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
                stay = at < np.repeat(first, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[order][stay]), part.column(0).take(pa.array(row[stay])), pa.array(sizes[row[stay]]), pa.array(at[stay])],
                    ["shingle", "node", "n", "at"])

    return sets.select("node", "shingles").mapInArrow(run, "shingle long, node long, n long, at long")


def near_duplicates(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, rounds: int = 3, sample: int = 5_000,
                    block: int = 1_024, key: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates: the one with the least key, then the least text hash.

    Texts are linked when their sets of distinct shingles have a Jaccard similarity of ``similarity`` or more; all
    such pairs count. In one order of all shingles, rare ones first, two sets of that similarity share a shingle of
    their prefixes, at places that leave room for the rest they must share. Entries that list the same shingle meet.
    Lists are first compared with one member of theirs, ``rounds`` times with another, which is linear in their size
    and connects most copies. Pairs that are connected by then need not be looked at; every other pair of every list
    is, lists of more than ``block`` entries in blocks of that size. Bitmaps of the sets rule out most pairs by a bound
    that holds for every pair, so that sets are moved for few.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = held(docs, key, "text").withColumnRenamed(key, "key").withColumn("digest", digest)
    node = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    copies = rows.groupBy("key", "digest").agg(F.count("*").alias("n"))
    copies = written(copies.withColumn("node", node), "copies")
    texts = rows.withColumn("node", node).join(
        copies.groupBy("node").agg(F.min("key").alias("key")).withColumnRenamed("key", "least"), "node").filter(
        F.col("key").eqNullSafe(F.col("least"))).select("node", "text")
    sets = written(shingle_sets(texts.dropDuplicates(["node"]), words_each), "shingles")
    count = max(1, sets.count())
    lot = F.pmod(F.xxhash64(F.lit("order"), F.col("node")), F.lit(1_000_000)) < int(min(1.0, sample / count) * 1_000_000)
    seen = sets.filter(lot).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    common = [(r["h"], r["n"]) for r in seen.orderBy(F.desc("n"), "h").limit(COMMON).collect()]
    posts = written(prefixes(sets, similarity, common), "prefixes")
    several = lambda col: [F.min(col).alias("_a"), F.max(col).alias("_b")]
    met = posts.groupBy("shingle").agg(*several("node")).filter("_a < _b").select("shingle")
    lists = written(posts.join(met, "shingle", "left_semi").withColumn("own", F.col("node")), "lists")

    def fit(x: str, y: str) -> Column:
        """What two entries with a shingle in common at these places can share at most, if none before it, is enough."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return 1 + F.least(n - F.col(f"{x}.at") - 1, m - F.col(f"{y}.at") - 1) >= similarity / (1 + similarity) * (n + m) - 1e-6

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        maps = sets.join(wanted, "node", "left_semi").select("node", F.size("shingles").alias("n"), *bitmap(F.col("shingles")))
        maps = written(maps, "bitmaps")
        enough = lambda common, m, n: common >= similarity * (m + n - common)
        named = lambda to: maps.select(F.col("node").alias(to), *[F.col(c).alias(f"{to}_{c}") for c in maps.columns[1:]])
        bound = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b")
        # A bit of one map that the other lacks stands for a shingle, or several, that the other lacks.
        alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_{c}").bitwiseAND(F.bitwise_not(f"{y}_{c}"))) for c in maps.columns[2:]), F.lit(0))
        most = F.least(F.col("a_n") - alone("a", "b"), F.col("b_n") - alone("b", "a"))
        likely = written(bound.filter(enough(most, F.col("a_n"), F.col("b_n"))).select("a", "b"), "likely")
        both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
        return written(both.filter(enough(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b"), "links")

    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(rounds):
        entry = F.struct("node", "own", "n", "at")
        lead = lists.groupBy("shingle").agg(F.min_by(entry, F.xxhash64(F.lit(turn), "node")).alias("y"))
        pairs = lists.select("shingle", entry.alias("x")).join(lead, "shingle").filter((F.col("x.own") != F.col("y.own")) & fit("x", "y"))
        pairs = pairs.groupBy(F.col("y.node").alias("a"), F.col("x.node").alias("b")).agg(F.count("*").alias("times"))
        best = pairs.groupBy("b").agg(F.max(F.struct("times", "a")).alias("of")).select(F.col("of.a").alias("a"), "b")
        found = similar(written(best, "nearest"))
        if not found.take(1):
            break
        edges = edges.unionByName(found)
        linked = written(lists.drop("own").join(components(edges), "node", "left").withColumn(
            "own", F.coalesce("component", "node")).drop("component"), "linked")
        open_lists = linked.groupBy("shingle").agg(*several("own")).filter("_a < _b").select("shingle")
        lists = written(linked.join(open_lists, "shingle", "left_semi"), "lists")
    # Of two entries that are not connected, one at least is not of the list's most frequent group.
    shares = lists.groupBy("shingle", "own").agg(F.count("*").alias("c")).groupBy("shingle").agg(
        F.max_by("own", F.struct("c", "own")).alias("most"), F.sum("c").alias("c"))
    shares = shares.withColumn("blocks", F.ceil(F.col("c") / block).cast("int")).drop("c")
    dealt = lists.join(shares, "shingle").select("shingle", "most", "blocks", F.struct("node", "own", "n", "at").alias("x"))
    rest = dealt.filter(F.col("x.own") != F.col("most")).drop("most").withColumn(
        "block", F.pmod(F.xxhash64("x.node"), F.col("blocks")).cast("int")).drop("blocks")
    every = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnRenamed("x", "y")
    left = rest.join(every, ["shingle", "block"]).filter(
        (F.col("x.own") != F.col("y.own")) & ((F.col("y.own") == F.col("most")) | (F.col("x.node") < F.col("y.node"))) & fit("x", "y"))
    left = left.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    found = components(edges.unionByName(similar(written(left, "left"))))
    group = F.coalesce("component", "node")
    kept = copies.join(found, "node", "left").groupBy(group.alias("group")).agg(F.min(F.struct("key", "digest", "n")).alias("first"))
    kept = kept.select(F.col("first.key").alias("least"), F.col("first.digest").alias("digest"), F.col("first.n").alias("n"))
    stay = rows.join(kept, ["digest"]).filter(F.col("key").eqNullSafe(F.col("least")))
    # A row that is there several times stays once.
    once = stay.filter(F.col("n") > 1).dropDuplicates(["key", "digest"])
    return released(stay.filter(F.col("n") == 1).unionByName(once), docs.columns)
