"""Secret scans: fixed shapes, and character Markov models of random strings and ordinary identifiers.

The shapes (assignments, access keys, hex runs) give base spans. Beside them, every run of
identifier characters of a minimum length is scored by two first-order character models: the mean
log-likelihood ratio of its transitions under "random string" against "ordinary identifier". A run
whose mean and total are above the limits, and which no base span overlaps, is a span of kind
``markov``. Models are fitted on labelled samples: values that the shapes find are random strings,
words outside of every shape are ordinary.

Only DataFrame functions run here. Positions are code points, ends exclusive, in the whole text.
Defined results: null and empty texts have no spans; if either label has no sample, no span is added
(no model can be compared); repeated rows are scanned alike; an empty table gives an empty result; all
input columns stay, but a result replaces an input column of its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import let
from idsieve.llm.words import held, released

# The shapes, in the order in which equal starts are listed.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a whole run fails below 20 characters, so it may as well not match
HEX = r"[0-9a-f]{24,}"
SHAPES = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARKED = "^" + ALPHABET  # the mark stands before the first character
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
RESULTS = ("base_spans", "added_spans")


@dataclass(frozen=True)
class Scan:
    min_length: int = 16
    min_mean: float = 0.3
    min_total: float = 8.0
    smoothing: float = 0.5
    #: Rows, picked by a hash of their text, that random strings and ordinary words are learned from, about.
    random_rows: int = 20_000
    ordinary_rows: int = 1_000


def _runs(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, value) of all matches: what stands between them gives their places."""
    shape = "struct<at:int,out:array<struct<start:int,end:int,value:string>>>"

    def place(both: Column) -> Column:
        step = lambda a, m: let(a["at"] + F.length(m["gap"]), lambda start: F.struct(
            (start + F.length(m["hit"])).alias("at"),
            F.array_append(a["out"], F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("end"),
                                              m["value"].alias("value"))).alias("out")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
        found = F.transform(both["hits"], lambda h, i: F.struct(
            h.alias("hit"), F.get(both["gaps"], i).alias("gap"), F.get(both["values"], i).alias("value")))
        return F.aggregate(found, zero.cast(shape), lambda a, m: step(a, m).cast(shape))["out"]

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.struct(hits.alias("hits"), values.alias("values"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(parts, place)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Sorted array of spans of the shapes; matches that are too short take their place but are dropped."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SHAPES):
        kept = F.filter(_runs(text, pattern, group), lambda x: F.length(x["value"]) >= least)
        found.append(F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPAN))
    return F.sort_array(F.concat(*found))


def _transitions(tokens: DataFrame) -> dict[str, int]:
    """Counts of character pairs over rows of (token, n); at most one row per pair of the alphabet comes back."""
    marked = F.concat(F.lit("^"), F.col("token"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(marked, i, F.lit(2)))
    rows = tokens.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in rows.collect()}


def fit(docs: DataFrame, scan: Scan = Scan()) -> list[float] | None:
    """Log-likelihood ratios of all transitions, row by row of the alphabet with its mark; None without samples."""
    rows = docs.count()
    if rows == 0:
        return None
    lot = F.pmod(F.xxhash64(F.lit("secrets"), F.col("text")), F.lit(1_000_000_000))
    pick = lambda n: docs.select("text").filter(F.col("text").isNotNull() & (lot < int(min(1.0, n / rows) * 1e9)))
    text = F.col("text")
    values = F.concat(*[
        F.when(text.rlike(p), F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v: F.length(v) >= least))
        .otherwise(F.array().cast("array<string>")) for _, p, g, least in SHAPES])
    random = pick(scan.random_rows).select(F.explode(values).alias("v")).select(
        F.explode(F.regexp_extract_all("v", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("token"))
    bare = text
    for _, p, _, _ in SHAPES:
        bare = F.regexp_replace(bare, p, " ")
    ordinary = pick(scan.ordinary_rows).select(
        F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token"))
    by_label = [_transitions(t.groupBy("token").agg(F.count("*").alias("n"))) for t in (random, ordinary)]
    if not all(by_label):
        return None
    out = []
    for a in MARKED:
        logs = []
        for counts in by_label:
            row = [counts.get(a + b, 0) + scan.smoothing for b in ALPHABET]
            logs.append([math.log(x / sum(row)) for x in row])
        out += [0.0, *[x - y for x, y in zip(*logs, strict=True)]]
    return out


def _ratio(token: Column, model: list[float]) -> Column:
    """Total log-likelihood ratio of a token."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    marked = F.concat(F.lit("^"), token)
    codes = F.transform(F.split(marked, ""), lambda c: F.call_function("instr", F.lit(MARKED), c) - 1)
    return let(codes, lambda k: F.aggregate(
        F.sequence(F.lit(1), F.length(token)), F.lit(0.0),
        lambda a, i: a + F.get(table, F.get(k, i - 1) * len(MARKED) + F.get(k, i))))


def scan(docs: DataFrame, model: list[float] | None, how: Scan = Scan()) -> DataFrame:
    """``docs`` with the arrays ``base_spans`` and ``added_spans`` of (start, rank, kind, end)."""
    out = held(docs, "text").withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("base_spans", base_spans(F.col("_text")))
    if model is None:
        return released(out.withColumn("added_spans", F.array().cast(SPAN)), docs.columns, *RESULTS)
    clear = lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    runs = F.filter(_runs(F.col("_text"), rf"[A-Za-z0-9+/_=-]{{{how.min_length},}}", 0), clear)
    odd = F.filter(runs, lambda x: let(_ratio(x["value"], model), lambda r: (
        (r >= how.min_total) & (r >= how.min_mean * F.length(x["value"])))))
    added = F.transform(odd, lambda x: F.struct(
        x["start"].alias("start"), F.lit(len(SHAPES)).alias("rank"), F.lit("markov").alias("kind"), x["end"].alias("end")))
    return released(out.withColumn("added_spans", added.cast(SPAN)), docs.columns, *RESULTS)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Texts with every span of a scan replaced by ``mark``; overlapping spans become one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast("struct<at:int,out:string>")
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap).alias("out")).cast("struct<at:int,out:string>")

    every = F.sort_array(F.concat("base_spans", "added_spans"))
    cut = let(F.aggregate(every, zero, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(F.size("base_spans") + F.size("added_spans") > 0, cut).otherwise(text)).drop(*RESULTS)
