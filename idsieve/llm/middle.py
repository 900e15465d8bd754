"""Fill-in-the-middle: documents cut at two places between tokens and put together in another order.

A text is a sequence of tokens: white space with the word after it, or white space alone at the end. One
full match of ``(token)*`` keeps every repetition of its group, so ``ends(1)`` says how many there are
and where each one ends; the cuts are looked up there. Nothing else needs Python: what is drawn for a
document is a hash of its key, and texts are put together and rebuilt by column expressions.

Defined results: null is the empty text; a text that is empty or holds a mark stays plain, and so does the
share of documents that is not drawn; a null key draws like the empty string; equal keys draw alike, so
repeated rows get equal results; texts are matched whole, whatever their length (time and memory grow in line
with it); an empty table gives an empty result; an input column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Possessive: a token is never given back, so the match keeps no places to return to.
TOKENS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")


@dataclass(frozen=True)
class Middle:
    seed: int = 42
    percent: int = 50  # of documents that are cut
    suffix_first: int = 80  # percent of these
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def cut(text: str | None, one: int, two: int) -> tuple[int, int, int]:
    """(tokens, end of the prefix, end of the middle), in code points, for two drawn numbers."""
    ends = TOKENS.fullmatch(text or "").ends(1)
    a, b = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
    return len(ends), ends[a - 1] if a else 0, ends[b - 1] if b else 0


CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    rows = [cut(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(text, one, two, strict=True)]
    n, first, second = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(n), pa.array(first), pa.array(second)], CUT.names)


def drawn(key: Column, seed: int, k: int) -> Column:
    """The k-th drawn number of a document, from 1 to 8: eight hex digits of a hash of its key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, how: Middle = Middle(), key: str = "doc_id") -> DataFrame:
    """The rows with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = (how.prefix, how.suffix, how.middle)
    plain = (text == "") | (drawn(F.col(key), how.seed, 3) % 100 >= how.percent)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(drawn(F.col(key), how.seed, 4) % 100 < how.suffix_first, "spm").otherwise("psm")
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results],
        form.alias("form"), F.arrow_udf(_cuts, CUT)("text", drawn(F.col(key), how.seed, 1), drawn(F.col(key), how.seed, 2)).alias("__cut"))
    first, second = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int")
    parts = {
        how.prefix: F.substring(text, F.lit(1), first), how.middle: F.substring(text, first + 1, second - first),
        how.suffix: F.substring(text, second + 1, F.length(text))}
    order = lambda *which: F.concat(*[x for m in which for x in (F.lit(m), parts[m])])
    output = F.when(F.col("form") == "plain", text).when(
        F.col("form") == "spm", order(how.suffix, how.prefix, how.middle)).otherwise(order(how.prefix, how.suffix, how.middle))
    placed = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("form", "__cut")], F.col("__cut.n").alias("n"), "form",
        placed(F.col("__cut.first")).alias("prefix_chars"),
        placed(F.col("__cut.second") - F.col("__cut.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, how: Middle = Middle()) -> Column:
    """The text from which ``output`` was made; the marks stand nowhere else in it."""
    pieces = F.split(output, "|".join(f"\\Q{m}\\E" for m in (how.prefix, how.suffix, how.middle)))
    prefix, suffix = F.when(form == "psm", pieces[1]).otherwise(pieces[2]), F.when(form == "psm", pieces[2]).otherwise(pieces[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, pieces[3], suffix))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || s[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b,
    array_to_string(u[greatest(x, y) + 1:], '') AS c
  FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b
    ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
