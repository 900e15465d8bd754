"""Column helpers for words: maximal runs of anything but blank, tab, LF, VT, FF and CR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null and for white space alone."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


HOLD = "__row"


def held(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, with the whole row beside them where no working column can clash with it."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(HOLD))


def released(df: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """The input's columns again, and the results; a result replaces an input column of its name."""
    rest = [F.col(HOLD)[c].alias(c) for c in columns if c.lower() not in {r.lower() for r in results}]
    return df.select(*rest, *results)
