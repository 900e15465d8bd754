"""MinHash forest: crowded regions find their depth in one join."""

import random

from pyspark.sql import functions as F
from test_forest import check

from idsieve.llm import forest


def test_rows_stop_where_their_region_is_small(spark):
    how, rnd = forest.Forest(region=3), random.Random(4)
    made = [(rnd.randrange(3), rnd.randrange(3), rnd.randrange(2), rnd.randrange(2), i, rnd.choice([i, 0, 1])) for i in range(120)]
    rows = spark.createDataFrame(made, "region long, v0 int, v1 int, v2 int, node long, group long")
    out = {r["node"]: (r["region"], r["size"], r["group"]) for r in forest.split(rows, how).collect()}
    left, stop = {r[4]: r for r in made}, {}
    for depth in range(1, 4):
        regions = {}
        for r in left.values():
            regions.setdefault(r[:1 + depth], []).append(r)
        some = [x for x in regions.values() if len({r[5] for r in x}) > 1]
        stop |= {r[4]: (r[:1 + depth], len(x), r[5]) for x in some if len(x) <= how.region or depth == 3 for r in x}
        left = {r[4]: r for x in some if len(x) > how.region for r in x}
    assert {n: x[1:] for n, x in out.items()} == {n: x[1:] for n, x in stop.items()} and len({x[1] for x in stop.values()}) > 3
    names = {(out[n][0], stop[n][0]) for n in stop}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})


def test_a_family_is_joined_once_below_its_first_depth(spark, monkeypatch):
    rnd, counted, write = random.Random(5), [], forest.written
    template = [f"t{i}" for i in range(240)]
    texts = [" ".join(template + [f"o{k}_{i}" for i in range(31)]) for k in range(40)] + [f"alone {k} {rnd.random()}" for k in range(5)]

    def count(df, name):
        out = write(df, name)
        if name == "regions":
            counted.append(out.agg(F.count("*")).first()[0])
        return out

    monkeypatch.setattr(forest, "written", count)
    check(spark, texts, forest.Forest(region=4))
    assert len(counted) == 2 and 0 < counted[1] <= counted[0] <= 32 * 40
