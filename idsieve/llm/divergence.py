"""Audit of how far the sources of each language differ in their words.

Identical texts of a language are one text with a number of copies per source. A text that is there once is
counted where it lies; copies are told by a digest, so a text with copies crosses the network once per map task
that holds it, and its words are looked at once. Counts and document frequencies are added with the copies as
weights, first inside a batch, then in Spark.

Every group gives every kept term a probability (in billionths, never 0), and two groups differ by the sum of
``f`` over all kept terms. Most terms are absent from most groups, so the sum is taken from what
occurs: V times the value of two absent terms, corrected by each group's own terms, which only depend on
how often they occur (a histogram of counts meets each other source), and by the terms that both have. All
numbers are whole: probabilities are divided out by steps of a thousand, so nothing overflows below
9 * 10^15 occurrences of a language, and sums of ``f`` stay below 2 * 10^9 plus twice the number of terms.

Defined results: null text, lang and source are empty strings, and those are a language and a source like any
other; a group without kept terms is at its place with value 0 or what smoothing gives; repeated rows count
each; ties are ordered by the item's bytes; texts are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsieve.llm.shared import by_copies, written
from idsieve.llm.tokens import blocks

#: Letters of terms stay, A-Z in lower case, all bytes beyond ASCII too; the rest separates.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SPREAD = 1_000_000  # weighted rows at once


@dataclass(frozen=True)
class Audit:
    least_documents: int = 10  # with a term, for it to be kept
    terms: int = 10  # reported of each group
    scale_steps: int = 3  # of a thousand each: probabilities are in billionths


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each text of a language once, with (source, n) for every source that has it."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))
    once, rows = by_copies(rows, "lang", "text")
    rows = rows.withColumn("digest", F.md5("text"))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")).groupBy("lang", "digest").agg(
        F.collect_list(F.struct("source", "n")).alias("copies"))  # one entry a source
    texts = rows.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    out = texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")
    if once is None:
        return out
    return once.select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("copies")).unionByName(out)


class Codes(dict):
    """Numbers for keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def weighted(langs: list[str], texts: list[str], sources: list[list[tuple[str, int]]]) -> Iterator[tuple[list, list, list, np.ndarray, np.ndarray]]:
    """(lang, source, term, n, docs) of some texts: occurrences in a source, and its documents with the term."""
    terms, groups = Codes(), Codes()
    flat, sizes = [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").translate(FOLD).split()
        flat.append(np.fromiter(map(terms.__getitem__, words), dtype=np.int64, count=len(words)))
        sizes.append(len(words))
    many = len(terms) + 1
    cell, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * many + np.concatenate(flat), return_counts=True)
    owner, term = cell // many, cell % many
    # Each text weighs in every group that has it.
    code = [[(groups[g, s], n) for s, n in own] for g, own in zip(langs, sources, strict=True)]
    width = np.array([len(c) for c in code])
    start = np.cumsum(width) - width
    of, weight = np.array([x for c in code for x in c], dtype=np.int64).reshape(-1, 2).T
    names, keys = list(terms), list(groups)
    ends = np.cumsum(width[owner])
    done = 0
    while done < len(owner):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SPREAD, side="right")))
        w = width[owner[done:upto]]
        row = np.repeat(np.arange(done, upto), w)
        at = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + start[owner[row]]
        place, back = np.unique(of[at] * many + term[row], return_inverse=True)
        total, docs = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        np.add.at(total, back, times[row] * weight[at])
        np.add.at(docs, back, weight[at])
        who, what = place // many, place % many
        yield [keys[k][0] for k in who.tolist()], [keys[k][1] for k in who.tolist()], [names[k].decode("utf-8", "surrogatepass") for k in what.tolist()], total, docs
        done = upto


def occurrences(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all collapsed texts: how often a term occurs in a source, and in how many of its documents."""

    def run(batches):
        for b in batches:
            langs, texts, own = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in blocks(texts):
                of = [[(c["source"], c["n"]) for c in row] for row in own[i:j]]
                for lang, source, term, n, docs in weighted(langs[i:j], texts[i:j], of):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n), pa.array(docs)],
                        ["lang", "source", "term", "n", "docs"])

    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, whole: Column, steps: int = 3) -> Column:
    """1 + floor(1000 ** steps * (count + 2) / whole), exactly; null where ``whole`` is 0."""
    d = F.nullif(whole, F.lit(0).cast("long"))
    left = count + F.lit(2).cast("long")
    out = _div(left, d)
    for _ in range(steps):
        left = (left % d) * 1000
        out = out * 1000 + _div(left, d)
    return out + 1


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: its distance to each other source, and its telling terms."""
    # A term of a language has one row a source, so one exchange brings them together: to keep it or not, and for its sums.
    term = Window.partitionBy("lang", "term")
    found = occurrences(collapsed(docs)).withColumns({
        "documents": F.sum("docs").over(term), "all_n": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
    counts = written(found.filter(F.col("documents") >= how.least_documents).select("lang", "source", "term", "n", "all_n", "lead"), "counts")
    kept = counts.filter("lead")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(blank("lang"), blank("source")).distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").na.fill(0, ["total", "terms"])
    none = F.lit(0).cast("long")
    p_of = lambda n: share(n, F.col("total") + 2 * F.col("terms"), how.scale_steps)
    groups = written(groups.withColumn("p0", p_of(none)), "groups")
    rows = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "all_n", "p0", p_of(F.col("n")).alias("p"))

    # Pairs of absent terms, own terms that the other lacks, and what terms of both change in that.
    side = lambda d, x: d.select("lang", *[F.col(c).alias(f"{x}_{c}") for c in d.columns if c not in ("lang", "term")], *[c for c in d.columns if c == "term"])
    pairs = side(groups, "a").join(side(groups, "b"), "lang").filter("a_source <> b_source")
    absent = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"),
                          F.coalesce(F.col("a_terms") * apart(F.col("a_p0"), F.col("b_p0")), none).alias("value"))
    shape = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    own = side(shape, "a").join(side(groups, "b"), "lang").filter("a_source <> b_source")
    own = own.groupBy("lang", "a_source", "b_source").agg(
        F.sum(F.col("a_k") * (apart(F.col("a_p"), F.col("b_p0")) - apart(F.col("a_p0"), F.col("b_p0")))).alias("value"))
    own_p = rows.drop("n", "all_n")
    both = side(own_p, "a").join(side(own_p, "b"), ["lang", "term"]).filter("a_source < b_source")
    p, q, p0, q0 = (F.col(c) for c in ("a_p", "b_p", "a_p0", "b_p0"))
    both = both.groupBy("lang", "a_source", "b_source").agg(
        F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value"))
    change = own.unionByName(both)
    turned = lambda x, y: change.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value")
    distance = absent.unionByName(turned("a_source", "b_source")).unionByName(turned("b_source", "a_source"))
    distance = distance.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    sizes = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    telling = rows.join(sizes, "lang").withColumn("q", p_of(F.col("all_n"))).filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return out(distance, "pair").unionByName(out(telling, "term").filter(F.col("rank") <= how.terms))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS s,
    (SELECT count(*) FROM k WHERE k.lang = g.lang)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) g),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.s + 2 * g.v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(s) + 2 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(s) AS s, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM f QUALIFY part = 'pair' OR rank <= 10
"""
