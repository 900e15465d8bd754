"""Fill-in-the-middle by round trips, and the divergence of sources against a plain version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idsieve.llm import divergence, middle, queries
from tools.check_oracle import rows as compared

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(alphabet="ab \t\n\x0b  é漢🙂<PSM>", max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=300, deadline=None)
def test_one_match_gives_all_ends(text, one, two):
    units = UNIT.findall(text)
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    assert middle.cut(text, one, two) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def plain(doc_id, text, how):
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < how.suffix_first:
        return len(units), "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return len(units), "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


@pytest.mark.parametrize("how", [middle.Middle(), middle.Middle(seed=7, percent=100, suffix_first=0), middle.Middle(percent=100, prefix="|a", suffix="|b", middle="|c")])
def test_middle(spark, how):
    rnd = random.Random(1)
    texts = [None, "", " ", "\n\t", "one", " one", "one ", "a <P> b", "x<S>", "<M", "🙂 漢字 é  z", "<" * 50 + " P> S> <", "w " * 300_000,
             *["".join(rnd.choices("ab \n🙂<", k=rnd.randint(0, 80))) for _ in range(150)]]
    shape = "doc_id long, text string, n string, form string, output int, `__cut` int, first int, prefix_chars int"
    d = spark.createDataFrame([(None if i % 40 == 39 else i, t, "n", "f", 0, 1, 2, 3) for i, t in enumerate(texts)] + [(5, " one", "n", "f", 0, 1, 2, 3)] * 2, shape)
    out = middle.transform(d.drop("__cut"), how).withColumn("back", middle.restored(F.col("output"), F.col("form"), how))
    assert out.columns == ["doc_id", "text", "first", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = out.collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], how)
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} >= ({"plain", "spm"} if how.suffix_first else {"plain", "psm"})
    assert middle.transform(d.filter("false").drop("__cut"), how).count() == 0


def audited(docs, how):
    """The report by its definition: every group gives every kept term a probability."""
    terms = [(g or "", s or "", [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]) for g, s, t in docs]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for g, s, w in terms:
        df[g].update(set(w))
        count[g, s].update(w)
    kept = {g: [w for w, n in c.items() if n >= how.least_documents] for g, c in df.items()}
    out = set()

    def shares(c, g):
        whole = sum(c[w] for w in kept[g]) + 2 * len(kept[g])
        return {w: 1 + 10**9 * (c[w] + 2) // whole for w in kept[g]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for g, s in count:
        p, q = shares(count[g, s], g), shares(sum((c for (x, _), c in count.items() if x == g), Counter()), g)
        pair = [(sum(f(p[w], r[w]) for w in kept[g]), o) for (x, o) in count if x == g and o != s for r in [shares(count[x, o], x)]]
        term = [(f(p[w], q[w]), w) for w in kept[g] if count[g, s][w] and p[w] > q[w]]
        for part, found, most in (("pair", pair, None), ("term", term, how.terms)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(g, s, part, item, v, k) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_divergence(spark, least, monkeypatch):
    monkeypatch.setattr(divergence, "SPREAD", 7)
    rnd = random.Random(least)
    words = ["Alpha", "alpha", "BETA", "gamma", "É", "é", "漢字", "x y", "z1z", "a_b", "it's"] + [f"w{chr(97 + i)}" for i in range(15)]
    docs = [(rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "b", "c", None, "é"]), " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for _ in range(150)]
    docs += [("en", "a", "copy of a text alpha")] * 40 + [("en", "b", "copy of a text alpha")] * 3 + [("de", "a", "copy of a text alpha")] * 2
    docs += [("zz", "a", None), ("zz", "b", ""), ("zz", None, "1 2 3 !"), ("yy", "a", "alone"), ("en", "long", "long words here " * 20_000)]
    shape = "lang string, source string, text string, n int, term string, digest int, value string"
    d = spark.createDataFrame([(*r, 1, "t", 2, "v") for r in docs], shape).repartition(3)
    how = divergence.Audit(least_documents=least, terms=4)
    got = [tuple(r) for r in divergence.audit(d, how).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(docs, how)
    assert divergence.audit(d.filter("false"), how).count() == 0


def test_shares_do_not_overflow(spark):
    n, whole = 8 * 10**15, 9 * 10**15
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(whole)), divergence.share(F.lit(0), F.lit(0))).first()
    assert tuple(got) == (1 + 10**9 * (n + 2) // whole, None)


def test_queries_agree_with_their_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    for name in ("op11_fill_in_middle", "op13_source_divergence"):
        df, cur = queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con.execute(queries.ORACLE[name])
        assert compared(df.columns, [tuple(r) for r in df.collect()]) == compared([c[0] for c in cur.description], cur.fetchall()), name
