"""The hash tree over audit chains: what it finds, proofs, and anchors in a row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from idsieve.operators import audit as oa, hash_tree as ht


@pytest.fixture(scope="module")
def chains(spark):
    rows = [(i, f"c{i % 41:02d}" if i % 41 else "c00", "analyze", "system", f"s {i}") for i in range(400)]
    return oa.append(spark.createDataFrame(rows, "id long, case_id string, action string, actor string, summary string")).cache()


def plain(tips, fan):
    level = [hashlib.sha256(f"{c}|{t}|{n}".encode()).hexdigest() for c, t, n in sorted(tips)]
    out = [(0, i, h) for i, h in enumerate(level)]
    k = 0
    while len(level) > 1:
        k += 1
        level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        out += [(k, i, h) for i, h in enumerate(level)]
    return out


@pytest.mark.parametrize("fan", [2, 5, 256])
def test_tree_and_proofs(spark, chains, fan):
    tips = ht.leaves(chains)
    nodes = ht.tree(tips, fan).cache()
    assert sorted((r.level, r.idx, r.hash) for r in nodes.collect()) == sorted(plain([tuple(r) for r in tips.collect()], fan))
    root = ht.anchor(nodes).first().root
    proofs = ht.proofs(nodes, fan)
    got = proofs.select("case_id", ht.proved_root(F.col("leaf"), F.col("proof")).alias("root")).collect()
    assert len(got) == 41 and {r.root for r in got} == {root}
    other = proofs.select(ht.proved_root(F.sha2(F.col("leaf"), 256), F.col("proof")).alias("root")).distinct().collect()
    assert [r.root for r in other] == [None]


def test_lost_cases_and_ends_are_found(spark, chains):
    kept = ht.leaves(chains)
    state = lambda d: {r.case_id: r.anchor_status for r in ht.compared(d, kept).collect() if r.anchor_status != "VALID"}
    assert state(chains) == {}
    assert state(chains.filter("case_id <> 'c07'")) == {"c07": "MISSING"}
    assert state(chains.filter("NOT (case_id = 'c08' AND id > 300)")) == {"c08": "TRUNCATED"}
    assert {r.chain_status for r in oa.verify(chains.filter("NOT (case_id = 'c08' AND id > 300)")).collect()} == {"VALID"}  # which the chain alone misses
    more = oa.append(spark.createDataFrame([(900, "c03", "review", "officer", "x"), (901, "new", "a", "b", "c")], "id long, case_id string, action string, actor string, summary string"),
                     kept.select("case_id", "tip"))
    assert state(chains.unionByName(more)) == {"c03": "EXTENDED", "new": "ADDED"}
    swapped = chains.withColumn("entry_hash", F.when(F.col("case_id") == "c09", F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    assert state(swapped) == {"c09": "REPLACED"}
    nodes, after = ht.tree(kept, 8), ht.tree(ht.leaves(chains.filter("case_id <> 'c07'")), 8)
    one, two = ht.anchor(nodes).first(), ht.anchor(after).first()
    assert one.root != two.root and ht.anchor(nodes, one.anchor).first().anchor != one.anchor


def test_broken_at_is_the_place_in_the_case(spark, chains):
    bad = chains.withColumn("summary", F.when(F.col("id").isin(45, 127), "x").otherwise(F.col("summary")))
    got = {r.case_id: r.broken_at for r in oa.broken_at(oa.links(bad)).collect() if r.broken_at is not None}
    assert got == {"c04": 1}
    assert ht.anchor(ht.tree(ht.leaves(chains.filter("false")))).first().root == oa.GENESIS_HASH
