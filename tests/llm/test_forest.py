"""MinHash forest against brute force over all pairs, its edge cases, and its parts."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from idsieve.llm import forest, queries


def word_sets(texts, k=2):
    cut = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset() for w in cut]


def least_of_groups(sets, percent=80):
    """For each place the least place that it is connected with."""
    group, posts = list(range(len(sets))), defaultdict(list)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for b, s in enumerate(sets):
        for a, n in Counter(i for x in s for i in posts[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[a]) - n):
                p, q = sorted((root(a), root(b)))
                group[q] = p
        for x in s:
            posts[x].append(b)
    return [root(i) for i in range(len(sets))]


def check(spark, texts, how=forest.Forest()):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in forest.groups(df, how).collect()}
    sets = word_sets(texts)
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i]["component"] for i in range(len(texts))] == least_of_groups(sets)


def test_whole_table(spark):
    found = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    out = {r["doc_id"]: r for r in queries.QUERIES["op12_minhash_forest"](spark, "/root/testdata/sf0.01").collect()}
    least = least_of_groups(word_sets([t for _, t in found]))
    assert {d: r["component_id"] for d, r in out.items()} == {found[i][0]: found[x][0] for i, x in enumerate(least)}
    assert all(r["kept"] == (d == r["component_id"]) for d, r in out.items())


def test_crowded_family_goes_the_exact_way(spark):
    """Texts of one template just below the limit share all regions; a few have a partner above it."""
    rnd = random.Random(2)
    template, made = [f"t{i}" for i in range(240)], []
    for k in range(120):
        own = [f"o{k}_{i}" for i in range(30)]
        made.append(" ".join(template + own))
        if k % 5 == 0:
            at = rnd.randrange(29)
            made.append(" ".join(template + own[:at] + [f"z{k}"] + own[at + 1:]).upper())
    rnd.shuffle(made)
    check(spark, made, forest.Forest(region=4, block=3_000))


def test_chain_and_tie_at_the_limit(spark):
    base = [f"w{i}" for i in range(101)]  # 100 shingles
    chain = [" ".join(base[:101 - 10 * k] if k else base) for k in range(6)]
    exact = [" ".join(f"p{i}" for i in range(n)) for n in (6, 5)]  # 4 of 5 shingles: at the limit
    below = [" ".join(f"q{i}" for i in range(n)) for n in (5, 4)]  # 3 of 4: below
    check(spark, chain + exact + below)


def test_edges(spark):
    long = " ".join(f"word{i % 9_973} and{i % 31}" for i in range(60_000))
    shape = "doc_id long, text string, n long, node long, `group` string, component string, region int, key string, own string"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "One"), (5, "oNE"), (6, "a b a b a b"), (6, "a b a b a b"), (None, "A B a"),
            (7, long), (8, long + " end"), (None, "only here twice"), (None, "only here twice"), (9, "Été x"), (10, "été x"), (11, "x y z")]
    df = spark.createDataFrame([(*r, 1, 2, "g", "c", 3, "k", "o") for r in rows], shape)
    out = defaultdict(set)
    for r in forest.groups(df).collect():
        out[r["doc_id"]].add((r["n_shingles"], r["component"]))
    assert out == {1: {(0, 1)}, 2: {(0, 2)}, 3: {(0, 3)}, 4: {(1, 4)}, 5: {(1, 4)}, 6: {(2, 6)}, None: {(2, 6), (2, None)}, 7: {(len(word_sets([long])[0]), 7)},
                   8: {(len(word_sets([long + " end"])[0]), 7)}, 9: {(1, 9)}, 10: {(1, 10)}, 11: {(1, 11)}}
    assert forest.groups(df.filter("false")).count() == 0 and forest.groups(df).columns == ["doc_id", "n_shingles", "component"]


@pytest.mark.parametrize("shared", [0, 300, 800])
def test_signatures_estimate_similarity(shared):
    rnd = np.random.default_rng(shared)
    a, b = (np.unique(rnd.integers(0, 1 << 64, 1000 - shared, dtype=np.uint64)) for _ in range(2))
    both = rnd.integers(0, 1 << 64, shared, dtype=np.uint64)
    how = forest.Forest(hashes=1024, orders=32)
    x, y = forest.signatures([np.r_[a, both], np.r_[b, both]], how)
    assert abs((x == y).mean() - shared / (2000 - shared)) < 0.06


def test_orders_share_no_first_positions():
    at = forest.Forest().positions()
    assert at.shape == (32, 6) and len(set(at[:, :4].ravel().tolist())) == 128 and all(len(set(r)) == 6 for r in at.tolist())


def test_blocks_give_only_links_that_connect():
    rnd = random.Random(5)
    base = [rnd.getrandbits(60) for _ in range(100)]
    sets = [np.unique(np.array([x for x in base if rnd.random() < 0.97] + [rnd.getrandbits(60)], dtype=np.uint64)) for _ in range(60)]
    block = forest.Block(forest.Forest())
    for i, s in enumerate(sets):
        block.add(s, i, i // 2)
    links = [(i, y) for i, s in enumerate(sets) for y in block.similar(s, i, i // 2, 0)]
    assert len(links) <= 29
    near = lambda i, j: 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))
    assert all(near(i, j) for i, j in links)

    def parts(pairs):
        own = [i // 2 for i in range(60)]
        for _ in range(60):
            for i, j in pairs:
                own = [min(own[i], own[j]) if g in (own[i], own[j]) else g for g in own]
        return own

    assert parts(links) == parts([(i, j) for i in range(60) for j in range(i) if near(i, j)])
