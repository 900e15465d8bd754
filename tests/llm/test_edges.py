"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from idsieve.llm import language, mixing, neighbours, packing, pages, quality, secrets, simhash, suffixes, tokens
from idsieve.llm.queries import vocabulary

SHAPE = ("doc_id long, text string, lang string, source string, n_chars long, kept string, _w string, node long, "
         "key string, size long, rank int, at string, n int, digest string, part int, taken string, base_spans string")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))


@pytest.fixture(scope="module")
def docs(spark):
    plain = " ".join(f"the cat{i} of house{i} and tree{i}" for i in range(40))
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, plain, "en", "a"), (4, plain, "en", "a"),
            (5, plain, "de", "a"), (6, plain.upper(), None, "b"), (7, LONG, "en", "c"), (None, plain + " x", "en", "c"),
            (8, "token = 'abcdef123456' x <|endoftext|> y", "en", "é"), (9, "one two", None, "漢"), (10, "\U0001f642 　 漢字", "zz", "a")]
    return spark.createDataFrame([(*r, 7, "clash", "w", 1, "k", 3, 1, "at", 2, "d", 0, "t", "b") for r in rows], SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_quality(docs, none):
    out = {r["doc_id"]: r for r in quality.judge(docs, quality.fit_references(docs)).collect()}
    assert len(out) == 11 and out[1]["n_words"] == 0 and out[1]["base_failed"] and not out[1]["kept"]
    assert out[4]["kept"] is True and out[4]["_w"] == "w" and out[7]["n_words"] == 80_000
    assert quality.fit_references(none) == [] and quality.judge(none, []).count() == 0
    assert quality.judge(docs, []).filter("kept").count() == docs.filter("length(text) > 300").count() - 0


def test_simhash(docs, none):
    out = simhash.groups(docs).collect()
    assert len(out) == 12
    by = {r["doc_id"]: r for r in out}
    assert by[1]["p0"] == by[2]["p0"] == by[3]["p0"] == 0 and by[3]["component"] == 1
    assert by[5]["component"] == by[6]["component"] == 4
    assert simhash.groups(none).count() == 0
    kept = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 not in ids and 5 not in ids and ids.count(None) == 1 and 1 in ids and 2 not in ids and {7, 8, 9, 10} <= set(ids)
    assert simhash.near_duplicates(none).count() == 0


def test_secrets(docs, none):
    found = secrets.scan(docs, secrets.fit(docs))
    out = {r["doc_id"]: r for r in found.collect()}
    assert [(s["start"], s["end"]) for s in out[8]["base_spans"]] == [(0, 21)] and out[1]["base_spans"] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    assert clean[8].startswith("[secret]' x") and clean[1] is None
    assert secrets.fit(none) is None and secrets.scan(none, None).count() == 0


def test_mixing(docs, none):
    sized = docs.withColumn("size", F.when(F.col("doc_id") == 7, 500).otherwise(F.col("doc_id")).cast("long")).na.fill(1, ["size"])
    rows = mixing.take(sized).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sums, want = {}, {}
    for r in rows:
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        want[r["source"]] = r["target"]
    assert all(abs(sums[s] - want[s]) <= 0.5 for s in sums) and None in sums
    assert sorted(map(str, rows)) == sorted(map(str, mixing.take(sized.repartition(1)).collect()))
    assert mixing.take(none).count() == 0


def test_packing(docs, none):
    p = packing.pack(docs, vocabulary(), packing.Packing(length=64)).collect()
    for s in {r["sequence_id"] for r in p}:
        own = sorted((r["offset"], r["length"]) for r in p if r["sequence_id"] == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == 64 or s == max(r["sequence_id"] for r in p)
    assert sum(r["length"] for r in p if r["doc_id"] == 4) == 2 * next(r["doc_tokens"] for r in p if r["doc_id"] == 4)
    assert packing.pack(none, vocabulary()).count() == 0
    few = packing.pack(docs, vocabulary(), packing.Packing(max_queues=2))
    assert few.agg(F.sum("length")).first()[0] == sum(r["length"] for r in p)
    shared = packing.pack(docs, vocabulary(), packing.Packing(length=64), shares={"a": 3, "c": 1}).filter("sequence_id < 10")
    assert shared.filter("doc_id in (7)").agg(F.sum("length")).first()[0] > 0


def test_tokens_language(docs, none):
    out = {r["doc_id"]: r for r in tokens.count_tokens(docs, vocabulary()).collect()}
    assert out[1]["n_tokens"] == 0 and out[7]["over_limit"] and tokens.count_tokens(none, vocabulary()).count() == 0
    profiles = language.learn(docs)
    out = {r["doc_id"]: r for r in language.predict(docs, profiles).collect()}
    assert set(profiles) == {"en", "de", "zz"} and out[1]["lang_pred"] == out[3]["lang_pred"] == "und" and out[7]["lang_pred"] == "en"
    assert language.learn(none) == {} and {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_suffixes(docs, none):
    out = {r["doc_id"]: r for r in suffixes.remove(docs).collect()}
    assert out[1]["n_bytes"] == 0 and out[4]["n_removed"] == out[4]["n_bytes"] == out[5]["n_removed"] and out[4]["n_spans"] == 1
    assert out[None]["n_bytes"] - out[None]["n_removed"] == 2 and out[6]["n_removed"] == 0 and out[9]["n_removed"] == 0
    assert suffixes.remove(none).count() == 0


def test_neighbours(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (8, [1.0]), (9, [])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    out = neighbours.search(v, v, neighbours.Index(k=3, probe_factor=100.0)).collect()
    near = {}
    for r in out:
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(near[1])[:3] == [(1, 2, 1.0), (2, 8, 1.0), (3, 8, 1.0)] and set(near) == {1, 2, 3, 8}
    assert neighbours.search(v.filter("false"), v).count() == 0 and neighbours.search(v, v.filter("false")).count() == 0


def test_pages(spark):
    page = "<html><nav>menu</nav><p>Same top</p><p>{}</p><div class='comments'>me</div><p>Same end</p></html>"
    rows = [(1, "http://h/a/1", page.format("first &amp; own")), (2, "http://h/a/2", page.format("second<br>own")), (3, None, None),
            (4, "http://other/", page.format("alone")), (5, "http://h/b", ""), (6, "::bad[", "<article><p>x y</p>\n<p>z</article>foot")]
    d = spark.createDataFrame([(*r, 0, "t") for r in rows], "page_id long, url string, html string, part int, text string")
    out = {r["page_id"]: r["text"] for r in pages.extract(d).collect()}
    assert out == {1: "first & own", 2: "second own", 3: "", 4: "Same top\n\nalone\n\nSame end", 5: "", 6: "x y\n\nz"}
    assert pages.extract(d.filter("false")).count() == 0


def test_stages(spark, docs, none):
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, "").columns == docs.columns, name
            stage(spark, rows, "").count()
        corpus_pipeline.STAGES[-1][1](spark, rows, "").count()
