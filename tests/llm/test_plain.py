"""Operators against plain versions, and queries against their SQL, over whole small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from idsieve.llm import pages, quality, queries, simhash, suffixes, tokens
from tools.check_oracle import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def result(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        df, cur = queries.QUERIES[name](spark, SF), con.execute(sql)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall()), name


def test_op1(spark, texts):
    got = result(spark, "op1_simhash")
    prints = {}
    for d, t in texts.items():
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", t.encode().lower()) if x]
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[d]["fingerprint"] == f"{prints[d]:016x}"
    own = {d: d for d in texts}
    for _ in range(20):
        for a in texts:
            own[a] = min(own[b] for b in texts if (prints[a] ^ prints[b]).bit_count() <= 2)
    assert own == {d: r["component_id"] for d, r in got.items()}


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_crowded_buckets_lose_no_link(spark, bucket):
    rng = random.Random(bucket)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(60)})
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    e = spark.createDataFrame(list(enumerate(signed)), "node long, p0 long")
    edges = {(min(r), max(r)) for r in simhash.links(e, simhash.Search(bucket=bucket)).collect()}

    def parts(pairs):
        own = list(range(len(fps)))
        for _ in range(30):
            for a, b in pairs:
                own[a] = own[b] = min(own[a], own[b])
        return own

    truth = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in edges) and parts(edges) == parts(truth)


def test_op2(spark):
    d = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").df()
    x, ids = np.stack(d.embedding.values).astype(float), d.vec_id.values
    got = {}
    for r in queries.QUERIES["op2_nearest_vectors"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len(set(ids[best]) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)


def test_op3_op6(spark, texts):
    t = Tokenizer.from_file(queries.vocabulary())
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}
    counts = result(spark, "op6_token_counts")
    assert {d: len(i) for d, i in ids.items()} == {d: r["n_tokens"] for d, r in counts.items()}
    for r in queries.QUERIES["op3_mixture_packing"](spark, SF).collect():
        own = np.array([*ids[r["doc_id"]], 1], dtype="<u4")
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_merging_agrees_with_the_library():
    t, m, rng = Tokenizer.from_file(queries.vocabulary()), tokens.Merger(queries.vocabulary()), random.Random(3)
    for _ in range(500):
        s = "".join(rng.choices("aaab the  \n\t'sré<|endoftext|>漢字  123ßẞ🙂\x1c\x85", k=rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", "a" * 50])
        assert m.count([s]) == [len(t.encode(s, add_special_tokens=False).ids)]


def test_op4(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for d, r in result(spark, "op4_secret_scan").items():
        t = texts[d]
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op5(spark, texts):
    seen = Counter(b[i:i + 400] for b in (t.encode() for t in texts.values()) for i in range(len(b) - 399))
    for d, r in result(spark, "op5_repeated_passages").items():
        b = texts[d].encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i:i + 400] = True
        rest = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        assert (r["n_removed"], r["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(rest).hexdigest())


def test_suffix_order(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(6)] + ["abab" * 12, "b"]
    letters = [(s, i, c) for s, t in enumerate(strings) for i, c in enumerate([*map(ord, t), -1 - s])]
    got = suffixes.suffix_order(spark.createDataFrame(letters, "seg long, idx int, name long")).orderBy("rank").collect()
    want = sorted((tuple([*map(ord, t), -1 - s][i:]), s, i) for s, t in enumerate(strings) for i in range(len(t) + 1))
    assert [(r["seg"], r["idx"]) for r in got] == [(s, i) for _, s, i in want]


def test_op7_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcde", k=rng.randint(0, 9))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pages.shared_lines(a, b)) == best[-1][-1]


def test_op9_op10(spark, texts):
    for d, r in result(spark, "op9_quality_rules").items():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[d])
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n, covered = Counter(tri), set()
        for i, x in enumerate(tri):
            covered |= {i, i + 1, i + 2} if n[x] > 1 else set()
        lines = [x for x in texts[d].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [r for r in result(spark, "op10_language_id").values() if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(4)
    made = []
    for _ in range(6):
        base = [f"w{rnd.randrange(5000)}" for _ in range(240)]
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for at in rnd.sample(range(240), rnd.choice([0, 1, 3])):
                copy[at] = f"x{rnd.randrange(5000)}"
            made.append(" ".join(copy))
    rnd.shuffle(made)
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, made)]
    group = list(range(len(made)))
    for b in range(len(made)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(df).collect()}
    assert kept == {min(i for i, g in enumerate(group) if g == x) for x in set(group)}


def test_bitmaps_bound_what_sets_share(spark):
    rnd = random.Random(5)
    pool = [rnd.getrandbits(64) - (1 << 63) for _ in range(400)]
    rows = [(i, rnd.sample(pool, rnd.choice([0, 1, 90, 300]))) for i in range(12)]
    maps = spark.createDataFrame(rows, "node long, s array<long>").select("node", "s", *simhash.bitmap(F.col("s"))).collect()
    full = [sum((r[f"m{k}"] & (1 << 64) - 1) << 64 * k for k in range(8)) for r in maps]
    for x, fx in zip(maps, full, strict=True):
        assert bin(fx).count("1") <= len(x.s) and (fx != 0) == bool(x.s)
        for y, fy in zip(maps, full, strict=True):
            assert len(set(x.s) & set(y.s)) <= len(x.s) - bin(fx & ~fy).count("1")


def linked_least(made):
    """Least places of the groups that brute force over all pairs of texts links."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, map(str.lower, made))]
    group = list(range(len(made)))
    for b in range(len(made)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return {min(i for i, g in enumerate(group) if g == x) for x in set(group)}


@pytest.mark.parametrize("block", [7, 1024])
def test_near_duplicates_inside_a_crowded_family(spark, block):
    """Pages of one template, three quarters of it the same: below the limit, but in each other's buckets all along."""
    rnd = random.Random(8)
    template, made = [f"t{i}" for i in range(180)], []
    for k in range(160):
        own = [f"o{k}_{i}" for i in range(30)]
        made.append(template + own)
        if k % 4 == 0:  # a true near-copy, its only partner somewhere in the family
            at = rnd.randrange(30)
            made.append(template + own[:at] + [f"z{k}"] + own[at + 1:])
    rnd.shuffle(made)
    made = [" ".join(x) for x in made]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_duplicates(df, block=block).collect()} == linked_least(made)


def test_near_duplicates_with_a_repeated_paragraph(spark):
    """Sets count a shingle once, however often its paragraph is there."""
    rnd = random.Random(9)
    made = []
    for k in range(30):
        base = [f"v{k}_{rnd.randrange(10**6)}" for _ in range(300)]
        made += [" ".join(base), " ".join(base + base[100:124] * 10).upper()]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(df).collect()}
    assert kept == linked_least(made) == set(range(0, 60, 2))


def test_op9_references_of_rare_languages(spark):
    rnd = random.Random(3)
    lists = {x: [f"{x}{i}" for i in range(12)] for x in ("en", "rare", "some")}

    def text(lang):
        return " ".join(rnd.choice(lists[lang]) if rnd.random() < 0.4 else f"{rnd.choice('abcdef')}{rnd.randrange(10**6):x}" for _ in range(120))

    rows = [(x, text(x)) for x, n in (("en", 3000), ("rare", 10), ("some", 60)) for _ in range(n)]
    rows += [("some", " ".join(f"copy{i % 20}" for i in range(120)))] * 100
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    rules = quality.Rules(fit_rows=70)
    found = quality.fit_references(d, rules)
    by = {r.lang: r for r in found}
    assert set(by) == set(lists) and by["rare"].texts == 10 and by["some"].texts == 61
    assert {w for w, _ in by["some"].common[:12]} == set(lists["some"])
    out = [r.lang for r in quality.judge(d, found, rules).filter("kept").collect()]
    assert Counter(out) == {"en": 3000, "rare": 10, "some": 60}


def page_texts(spark, rows):
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.extract(d).collect()}


def test_op7_copies_keep_their_article(spark):
    html = "<p>Site line on top</p><p>The whole long article {} of this page stands here</p><p>Dated {}</p><p>Site line below</p>"
    rows = [(i, f"http://h/a{x}", html.format("one", 1)) for i, x in enumerate(("", "/", "?print=1", "?p=2", "?p=3"))]
    rows += [(9, "http://h/b", html.format("two", 2)), (10, "http://g/x/1", "<p>" + "long text " * 40 + "</p><p>v1</p>"),
             (11, "http://g/x/2", "<p>" + "long text " * 40 + "</p><p>v2</p>")]
    out = page_texts(spark, rows)
    assert {out[i] for i in range(5)} == {"The whole long article one of this page stands here\n\nDated 1"}
    assert out[9].startswith("The whole long article two") and out[10].endswith("v1") and len(out[11]) > 400


def test_op7_pairs_marked_pages(spark):
    page = "<article><h1>Title {0}</h1><p>Own words of page {0} come here.</p><p>Subscribe to our letter</p></article><p>foot</p>"
    teaser = "<article><p>Teaser {0}</p></article><p>The real text of {0} stands outside of it.</p><article class='comment'><p>me too {0}</p></article>"
    rows = [(i, f"http://h/n/{i}", page.format(i)) for i in range(4)] + [(10 + i, f"http://t/n/{i}", teaser.format(i)) for i in range(4)]
    out = page_texts(spark, rows)
    assert out == {**{i: f"Title {i}\n\nOwn words of page {i} come here." for i in range(4)},
                   **{10 + i: f"Teaser {i}\n\nThe real text of {i} stands outside of it." for i in range(4)}}


def test_near_duplicates_of_a_whole_table(spark):
    found = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    df = spark.createDataFrame(found, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(df).collect()}
    assert kept == {found[i][0] for i in linked_least([x for _, x in found])}
