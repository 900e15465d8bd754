"""Masking and text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idsieve.functions.common import case, strip
from idsieve.functions.fixed import (
    DATE_FIELDS, NUMBER_FIELDS, PERSON_FIELDS, SENSITIVE_FIELDS,
)


def mask_number(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("X"), n)).otherwise(
        F.concat(F.repeat(F.lit("X"), n - 4), F.right(text, F.lit(4)))
    )


def mask_address(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 8, F.lit("XXXX")).otherwise(
        F.concat(F.left(text, F.lit(3)), F.lit("…"), F.repeat(F.lit("X"), F.least(n - 3, F.lit(8))))
    )


def mask_person(text: Column) -> Column:
    """First letter of each word stays; a one-letter word becomes X."""
    return F.array_join(
        F.transform(
            F.split(text, r"\s+"),
            lambda w: F.when(F.length(w) <= 1, F.lit("X")).otherwise(
                F.concat(F.left(w, F.lit(1)), F.repeat(F.lit("X"), F.length(w) - 1))
            ),
        ),
        " ",
    )


def mask_value(field: Column, value: Column) -> Column:
    """Masked form of ``value`` for the named field; other fields pass unchanged."""
    text, key = strip(value), F.lower(field)
    return case(
        (F.length(text) == 0, text),
        (key.isin(*NUMBER_FIELDS), mask_number(text)),
        (key == "address", mask_address(text)),
        (key.isin(*PERSON_FIELDS), mask_person(text)),
        (key.startswith("mrz"), F.regexp_replace(F.upper(text), "[A-Z0-9]", "X")),
        (key.isin(*DATE_FIELDS), F.regexp_replace(text, r"\d", "X")),
        otherwise=text,
    )


def is_sensitive(field: Column) -> Column:
    key = F.lower(field)
    return key.isin(*SENSITIVE_FIELDS) | key.startswith("mrz")


def normalize_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))
