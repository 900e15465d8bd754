"""Field extraction rules as Column expressions over a document's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idsieve.functions.common import blank_to_null, case, first_group, let, strip
from idsieve.functions.fixed import (
    LABEL_WORDS, MIN_EXTRACTED_CONFIDENCE, PATTERNS, PROFILES,
)
from idsieve.functions.text import normalize_text

_NEXT_LABEL = r"(?is)[\s,]+(?:" + "|".join(LABEL_WORDS) + r")\b.*$"


def expects(document_type: Column, field: str) -> Column:
    """Does the profile of this type list the field?"""
    return document_type.isin(*[p[0] for p in PROFILES if field in p[3]])


def match(text: Column, name: str) -> Column:
    return first_group(text, PATTERNS[name])


def first_of(text: Column, *names: str) -> Column:
    return F.coalesce(*[match(text, n) for n in names])


def person(captured: Column, compat: bool = False) -> Column:
    """A captured name, cut before the next field label unless ``compat``."""
    cut = captured if compat else F.regexp_replace(captured, _NEXT_LABEL, "")
    return blank_to_null(normalize_text(F.replace(cut, F.lit(","), F.lit(" "))))


def document_number(document_type: Column, text: Column) -> Column:
    """The type's ordered pattern list, first match wins."""
    up = F.upper(text)
    t = document_type
    return case(
        (t == "PAN", first_of(up, "pan_label", "pan")),
        (t == "AADHAAR", match(text, "aadhaar")),
        (t == "PASSPORT", first_of(up, "passport_label", "passport")),
        (t == "DRIVING_LICENCE", first_of(up, "licence_label", "licence")),
        (t == "VISA", first_of(up, "visa_number", "generic_id", "passport")),
        (t == "PERMIT", first_of(up, "generic_id", "passport", "pan")),
        (t == "NATIONAL_ID", F.coalesce(match(text, "aadhaar"), first_of(up, "pan", "generic_id"))),
        otherwise=F.coalesce(match(text, "aadhaar"), first_of(up, "pan", "passport", "licence")),
    )


def number_shape(document_type: Column, value: Column) -> Column:
    """PASS when the number has the public shape of its type, else WARNING."""
    t = document_type

    def shape(v: Column) -> Column:
        ok = case(
            (t == "PAN", v.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")),
            (t == "AADHAAR", F.length(F.regexp_replace(v, r"\D", "")) == 12),
            (t == "PASSPORT", v.rlike("^[A-Z][0-9]{7}$")),
            (t == "DRIVING_LICENCE", F.length(F.regexp_replace(v, r"[\s\-]", "")) >= 8),
            (t.isin("VISA", "PERMIT", "NATIONAL_ID"), F.length(v) >= 6),
            otherwise=F.length(v) >= 4,
        )
        return F.when(ok, F.lit("PASS")).otherwise(F.lit("WARNING"))

    return let(F.upper(F.replace(value, F.lit(" "))), shape)


def reconcile(confidence: Column, validation: Column) -> Column:
    """A format PASS needs a transcription confidence."""
    low = confidence < MIN_EXTRACTED_CONFIDENCE
    return F.when(low & (validation == "PASS"), F.lit("WARNING")).otherwise(validation)


def field_status(confidence: Column, validation: Column) -> Column:
    bad = (confidence < MIN_EXTRACTED_CONFIDENCE) | (validation == "FAIL")
    return F.when(bad, F.lit("UNCERTAIN")).otherwise(F.lit("EXTRACTED"))


def sex_code(raw: Column, document_type: Column) -> Column:
    up = F.upper(raw)
    return case(
        (up.startswith("M"), "M"),
        (up.startswith("F"), "F"),
        (document_type == "PASSPORT", up),
        otherwise=F.left(up, F.lit(1)),
    )


def source_region(bbox: Column) -> Column:
    """Corner form of an x, y, w, h box; null for a missing box."""
    return F.when(bbox.isNotNull(), F.struct(
        bbox["x"].alias("x"), bbox["y"].alias("y"), bbox["w"].alias("w"), bbox["h"].alias("h"),
        (bbox["x"] + bbox["w"]).alias("x2"), (bbox["y"] + bbox["h"]).alias("y2"),
    ))


def strip_all(c: Column) -> Column:
    return F.upper(F.regexp_replace(strip(c), r"\s+", ""))
