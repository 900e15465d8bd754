"""MinHash near-duplicates by a forest of sorted signature orders.

A document's signature holds one minimum of its shingles per hash function. Each order of the forest is a prefix
tree over signatures whose positions it takes in a sequence of its own: documents under one node of a tree share
that prefix. A region is split one position deeper only while it holds more than ``region`` documents, so the
depth follows the data; in a region that is small enough, all its documents are candidates of each other.

Whatever the data, no order goes deeper than ``last`` positions, so two documents of similarity s are missed
by all orders with a chance of at most (1 - s ** last) ** orders: 6 in 100,000 at 0.8 if every region around them is split
to the end, below 1 in 10^9 where regions end at ``first``. Regions that are still crowded at the end go an exact
way: groups that are linked by then need no comparison inside, and all other pairs are compared on their full sets, in
blocks.

Equal sets are one entry all along. Candidates must have sizes that allow the similarity, and sketches (one bit
of each minimum) that differ in at most ``bits_apart`` places, which a pair at the limit exceeds with a chance of
3 in 10^7; what remains is confirmed on the full sets of the texts. One pair per document comes first, its nearest
leader of a region, so that groups of copies are known before pairs are formed.

Defined results: a null or wordless text has an empty set and is a component of its own, as is any row that links
with nothing; a text of fewer words than a shingle is one shingle; repeated rows and copies share an entry; a
null key never names a component unless it has no other, and such a row is kept; an empty table gives an empty
result; columns other than key and text are not read; texts are read whole. Shingles are told by 64-bit hashes, sets
by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.llm.components import components
from idsieve.llm.shared import checkpointed, removed, written
from idsieve.llm.tokens import blocks

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    words: int = 2
    percent: int = 80
    orders: int = 32
    hashes: int = 128
    first: int = 3  # positions that a region shares at least
    last: int = 6
    region: int = 32
    bits_apart: int = 32
    quick: int = 4  # orders that are looked at first, one pair per document
    block: int = 200_000  # shingles that are held at once where a crowded region is compared in full
    seed: int = 42

    def positions(self) -> np.ndarray:
        """The positions of the signature that each order takes, one after the other; first ones are of no other order."""
        own = np.arange(self.hashes).reshape(self.orders, -1)
        more = np.random.default_rng(self.seed).permuted(np.tile(np.arange(self.hashes), (self.orders, 1)), axis=1)
        return np.array([[*o, *[x for x in m if x not in o]][:self.last] for o, m in zip(own.tolist(), more.tolist(), strict=True)])


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, known: Hashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, in lower case."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(known) > 1_000_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    width = min(words, len(w))
    if not width:
        return h
    out = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * MULTIPLIER + h[k:k + len(out)]
    out = (out ^ (out >> np.uint64(32))) * MULTIPLIER
    return np.unique(out ^ (out >> np.uint64(29)))


def signatures(sets: list[np.ndarray], how: Forest) -> np.ndarray:
    """One row of 32-bit minima for each set that is not empty."""
    rng = np.random.default_rng(how.seed)
    by, plus = (rng.integers(0, 1 << 64, how.hashes, dtype=np.uint64) for _ in range(2))
    sizes = np.array([len(s) for s in sets])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), how.hashes), dtype=np.uint32)
    for k in range(how.hashes):
        out[:, k] = np.minimum.reduceat(flat * (by[k] | np.uint64(1)) + plus[k], starts) >> np.uint64(32)
    return out


def signed(docs: DataFrame, how: Forest, key: str) -> DataFrame:
    """(key, own, n, digest, s0, s1, signature): ``own`` is a digest of the text, ``digest`` one of its set, null when that is empty."""

    def run(batches):
        known = Hashes()
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in blocks([t or "" for t in texts], 1_000_000):
                sets = [shingle_set(t, how.words, known) for t in texts[i:j]]
                some = [k for k, s in enumerate(sets) if len(s)]
                rows: list[bytes | None] = [None] * len(sets)
                sketch = np.zeros((len(sets), how.hashes // 64), dtype=np.int64)
                if some:
                    found = signatures([sets[k] for k in some], how)
                    sketch[some] = np.packbits((found & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                    for k, row in zip(some, found, strict=True):
                        rows[k] = row.tobytes()
                digests = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), *[pa.array(c) for c in sketch.T], pa.array(rows, pa.binary())], names)

    sketches = [f"s{k}" for k in range(how.hashes // 64)]
    names = ["key", "own", "n", "digest", *sketches, "signature"]
    kind = docs.schema[key].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.md5(text).alias("own"), text).mapInArrow(
        run, f"key {kind}, own string, n long, digest binary, {', '.join(f'{s} long' for s in sketches)}, signature binary")


def prefixes(entries: DataFrame, how: Forest, orders: range) -> DataFrame:
    """(region, v0 .., and the columns of a candidate) of each entry in each order: a hash of its first positions, and the next ones."""
    at, deeper = how.positions(), how.last - how.first
    rest = [c for c in entries.columns if c != "signature"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2_048):
                part = b.slice(i, 2_048)
                x = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1)
                for t in orders:
                    h = np.full(len(x), t + 1, dtype=np.uint64)
                    for p in at[t, :how.first]:
                        h = (h ^ (h >> np.uint64(29))) * MULTIPLIER + x[:, p]
                    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
                    more = [pa.array(x[:, p].view(np.int32)) for p in at[t, how.first:]]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *more, *[part.column(c) for c in rest]],
                                                     ["region", *[f"v{k}" for k in range(deeper)], *rest])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema if f.name != "signature"]
    return entries.mapInArrow(run, ", ".join(["region long", *[f"v{k} int" for k in range(deeper)], *kinds]))


def sketch_columns(how: Forest) -> list[str]:
    return [f"s{k}" for k in range(how.hashes // 64)]


def possible(how: Forest, x: str, y: str) -> Column:
    """Whether sizes and sketches of two entries allow the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= how.percent * F.greatest(n, m)) & (bits(how, x, y) <= how.bits_apart)


def bits(how: Forest, x: str, y: str) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sketch_columns(how)])


def region_pairs(rows: DataFrame, how: Forest) -> DataFrame:
    """(a, b): possible pairs inside regions of at most ``region`` entries, of different groups."""
    sketches = sketch_columns(how)

    def run(batches):
        held = None
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((len(names), 0), dtype=np.int64)
            x = x if held is None else np.concatenate([held, x], axis=1)
            # The last region may go on in the next batch.
            end = int(np.searchsorted(x[0], x[0, -1])) if x.shape[1] else 0
            held = x[:, end:]
            yield from pairs(x[:, :end])
        if held is not None:
            yield from pairs(held)

    def pairs(x):
        for k in range(1, how.region):
            i = np.flatnonzero(x[0, :-k] == x[0, k:])
            if not len(i):
                return
            p, q = x[:, i], x[:, i + k]
            off = sum(np.bitwise_count((p[r] ^ q[r]).view(np.uint64)).astype(np.int64) for r in range(4, len(names)))
            ok = (p[2] != q[2]) & (100 * np.minimum(p[3], q[3]) >= how.percent * np.maximum(p[3], q[3])) & (off <= how.bits_apart)
            p, q = p[:, ok], q[:, ok]
            swap = p[1] > q[1]
            for at in range(0, len(swap), 100_000):
                s, to = swap[at:at + 100_000], slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(s, q[1, to], p[1, to])), pa.array(np.where(s, p[1, to], q[1, to]))], ["a", "b"])

    names = ["region", "node", "group", "n", *sketches]
    dealt = rows.select(*names).repartition("region").sortWithinPartitions("region", "node")
    return dealt.mapInArrow(run, "a long, b long")


def texts_of(nodes: DataFrame, entries: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(node, text) of the nodes: a text whose set is the entry's."""
    wanted = entries.select("node", "key", "own").join(nodes, "node")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.md5(text).alias("o"), text.alias("text"))
    same = F.col("k").eqNullSafe(F.col("key")) & (F.col("o") == F.col("own"))
    return rows.join(wanted, same).groupBy("key", "own", "node").agg(F.any_value("text").alias("text")).select("node", "text")


def confirmed(pairs: DataFrame, entries: DataFrame, docs: DataFrame, how: Forest, key: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a table."""
    pairs = pairs.select("a", "b")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(wanted, entries, docs, key)
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def run(batches):
        known = Hashes()
        cached = lru_cache(maxsize=8)(lambda t: shingle_set(t, how.words, known))
        for b in batches:
            stay = []
            for i, (t, u) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = cached(t.as_py()), cached(u.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= how.percent * (len(x) + len(y) - same):
                    stay.append(i)
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return written(both.mapInArrow(run, "a long, b long"), "links")


def grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with ``group``: the component of their node, or the node itself."""
    return rows.drop("group").join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def open_regions(rows: DataFrame) -> DataFrame:
    """The rows, with ``size``, of regions that hold more than one group."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("group").alias("_a"), F.max("group").alias("_b"))
    return rows.join(sizes.filter("_a < _b").select("region", "size"), "region")


def split(rows: DataFrame, how: Forest) -> DataFrame:
    """Crowded rows (region, v0 ..) with the deeper region, and its ``size``, at which each of them stops.

    That is the first with at most ``region`` entries, or else the last. Regions of every depth are counted from one
    aggregate of the deepest, so each row is joined once, not once a depth. Rows whose region holds one group drop out.
    """
    depths = range(how.last - how.first)
    for d in depths:
        rows = rows.withColumn(f"r{d}", F.xxhash64("region" if d == 0 else f"r{d - 1}", f"v{d}")).drop(f"v{d}")
    own = [f"r{d}" for d in depths]
    leaves = checkpointed(rows.groupBy(*own).agg(F.count("*").alias("n"), F.min("group").alias("a"), F.max("group").alias("b")))
    stops = leaves.select(*own, F.struct("n", "a", "b").alias(f"s{own[-1]}"))
    for r in own[:-1]:
        sizes = leaves.groupBy(r).agg(F.struct(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).alias(f"s{r}"))
        stops = stops.join(sizes, r)
    stop = F.coalesce(*[F.when((F.col(f"s{r}.n") <= how.region) | (F.col(f"s{r}.a") == F.col(f"s{r}.b")), F.struct(F.col(r).alias("region"), f"s{r}.*"))
                        for r in own], F.struct(F.col(own[-1]).alias("region"), f"s{own[-1]}.*"))
    stops = stops.select(F.col(own[-1]), stop.alias("stop")).filter("stop.a < stop.b")
    stops = stops.select(own[-1], F.col("stop.region").alias("region"), F.col("stop.n").alias("size"))
    return rows.drop("region", *own[:-1]).join(stops, own[-1]).drop(own[-1])


def crowded_links(rows: DataFrame, entries: DataFrame, docs: DataFrame, how: Forest, key: str) -> DataFrame:
    """All links between different groups inside crowded regions, as a table.

    A region's entries are dealt into blocks of about ``block`` shingles. Whoever is not of the region's largest
    group visits every block, one after the other, and is counted against all its full sets at once; only links
    that connect something come out. So a family of texts just below the limit costs comparisons, but no rows.
    """
    sizes = rows.groupBy("region", "group").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("region").agg(
        F.max_by("group", F.struct("c", "group")).alias("most"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    sizes = sizes.filter("groups > 1").select("region", "most", F.ceil(F.col("n") / how.block).cast("int").alias("blocks"))
    dealt = written(rows.select("region", "node", "group").join(sizes, "region"), "crowded")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = dealt.select("region", own.alias("block"), F.lit(False).alias("visits"), "node", "group", "most")
    visits = dealt.filter("group <> most").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "node", "group", "most")
    texts = texts_of(dealt.select("node").distinct(), entries, docs, key)
    met = members.unionByName(visits).join(texts, "node").repartition("region", "block").sortWithinPartitions("region", "block", "visits", "node")

    def run(batches):
        known, at, block = Hashes(), None, None
        for b in batches:
            found: list[tuple[int, int]] = []
            for region, number, visit, node, group, most, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (region, number) != at:
                    at, block = (region, number), Block(how)
                s = shingle_set(text, how.words, known)
                if visit:
                    found += [(min(node, y), max(node, y)) for y in block.similar(s, node, group, most)]
                else:
                    block.add(s, node, group)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    out = written(met.select("region", "block", "visits", "node", "group", "most", "text").mapInArrow(run, "a long, b long").distinct(), "links")
    removed(dealt)
    return out


class Block:
    """Sets that visiting sets are counted against. A link is given out only where it connects groups that no
    earlier one of the block has connected: the components stay the same, and copies of copies give no pairs.
    """

    def __init__(self, how: Forest):
        self.how, self.sets, self.nodes, self.groups = how, [], [], []
        self.values, self.root = None, {}

    def top(self, group: int) -> int:
        while (up := self.root.get(group, group)) != group:
            self.root[group] = group = self.root.get(up, up)
        return group

    def add(self, s: np.ndarray, node: int, group: int) -> None:
        self.sets.append(s)
        self.nodes.append(node)
        self.groups.append(group)

    def similar(self, s: np.ndarray, node: int, group: int, most: int) -> list[int]:
        if self.values is None and self.sets:
            self.sizes = np.array([len(x) for x in self.sets])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.values, self.ids = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.nodes, self.groups, self.sets = np.array(self.nodes), np.array(self.groups), []
        if self.values is None:
            return []
        has = np.zeros(len(self.values), dtype=np.int64)
        has[np.searchsorted(self.values, np.intersect1d(self.values, s, assume_unique=True))] = 1
        same = np.add.reduceat(has[self.ids], self.starts)
        near = 100 * same >= self.how.percent * (self.sizes + len(s) - same)
        near &= (self.groups != group) & ((self.groups == most) | (self.nodes > node))
        met, at = np.unique(self.groups[near], return_index=True)
        out = []
        for other, y in zip(met.tolist(), self.nodes[near][at].tolist(), strict=True):
            a, b = self.top(group), self.top(other)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                out.append(y)
        return out


def links(entries: DataFrame, docs: DataFrame, how: Forest, key: str) -> DataFrame:
    """Confirmed edges (a, b) that connect what is similar."""
    # First one pair per document: the nearest of the leaders of its regions in a few orders.
    entry = F.struct("node", "n", *sketch_columns(how))
    rows = prefixes(entries.drop("key", "own", "digest"), how, range(how.quick)).select("region", entry.alias("x"))
    lead = rows.groupBy("region").agg(F.min_by("x", F.xxhash64(F.col("x.node"))).alias("y"))
    near = rows.join(lead, "region").filter((F.col("x.node") != F.col("y.node")) & possible(how, "x", "y"))
    near = near.groupBy(F.col("x.node").alias("b")).agg(F.min(F.struct(bits(how, "x", "y"), F.col("y.node").alias("a"))).alias("of"))
    near = written(near.select("of.a", "b"), "nearest")
    edges = confirmed(near, entries, docs, how, key)
    found = written(components(edges), "groups")

    # Then all orders, down to small regions; entries of one group are no longer candidates of each other.
    rows = grouped(prefixes(entries.drop("key", "own", "digest"), how, range(how.orders)), found)
    small, crowded = F.col("size") <= how.region, F.col("size") > how.region
    above = written(open_regions(rows), "regions")
    pairs = [written(region_pairs(above.filter(small), how), "pairs")]
    if how.last > how.first:
        deeper = written(split(above.filter(crowded).drop("size"), how), "regions")
        removed(above)
        above = deeper
        pairs.append(written(region_pairs(above.filter(small), how), "pairs"))
    tried = reduce(DataFrame.unionByName, pairs).select("a", "b").distinct()
    near_by = confirmed(written(tried, "tried"), entries, docs, how, key)
    removed(*pairs)

    # What is still crowded is compared in full. Groups stand for the links inside of them.
    rest = crowded_links(above.filter(crowded), entries, docs, how, key)
    removed(above)
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near_by).unionByName(rest)


def groups(docs: DataFrame, how: Forest = Forest(), key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component) of every row: the least key that is reached through links, itself included."""
    rows = written(signed(docs, how, key), "signatures")
    some = rows.filter(F.col("digest").isNotNull())
    names = ["n", *sketch_columns(how), "signature"]
    entries = some.groupBy("digest").agg(F.min(F.struct("key", "own")).alias("of"), F.min("key").alias("least"), *[F.any_value(c).alias(c) for c in names])
    entries = written(entries.select(F.monotonically_increasing_id().alias("node"), "digest", "of.key", "of.own", "least", *names), "entries")
    found = components(links(entries.drop("least"), docs, how, key))
    named = grouped(entries.select("node", "digest", "least"), found)
    named = named.join(named.groupBy("group").agg(F.min("least").alias("component")), "group").select("digest", "component")
    out = rows.select("key", "n", "digest").join(named, "digest", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "key").alias("component"))
