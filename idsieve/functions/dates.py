"""Date parsing and plausibility checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idsieve.functions.common import case, flags, let, strip

# Accepted shapes, tried in this order.
DAY_FIRST = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{4})$"
YEAR_FIRST = r"^(\d{4})[/\-.](\d{2})[/\-.](\d{2})$"
SHORT_YEAR = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{2})$"
MONTH_NAME = r"^(\d{2})\s([A-Za-z]{3})\s(\d{4})$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
SHORT_YEAR_PIVOT = 69
EXPIRED_NOTE = "Document appears EXPIRED. Expiry does not determine authenticity."


def _iso(v: Column) -> Column:
    short = F.regexp_replace(v, SHORT_YEAR, "$3-$2-$1")
    century = F.when(short >= f"{SHORT_YEAR_PIVOT}", F.lit("19")).otherwise(F.lit("20"))
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(v, 4, 3)))
    month = F.when(at % 3 == 1, F.format_string("%02d", F.floor((at + 2) / 3).cast("int")))
    return case(
        (v.rlike(DAY_FIRST), F.regexp_replace(v, DAY_FIRST, "$3-$2-$1")),
        (v.rlike(YEAR_FIRST), F.regexp_replace(v, YEAR_FIRST, "$1-$2-$3")),
        (v.rlike(SHORT_YEAR), F.concat(century, short)),
        (v.rlike(MONTH_NAME), F.concat_ws(
            "-", F.right(v, F.lit(4)), F.coalesce(month, F.lit("00")), F.left(v, F.lit(2)))),
        otherwise="",
    )


def iso_text(value: Column) -> Column:
    """``yyyy-MM-dd`` text of a recognised shape, '' when no shape fits.

    Two-digit years follow the POSIX pivot, which Spark's ``yy`` does not.
    """
    return let(strip(value), _iso)


def parse_date(value: Column) -> Column:
    """struct(date, status); status PARSED, EMPTY, IMPOSSIBLE_DATE or UNRECOGNIZED_FORMAT."""

    def status(iso: Column, date: Column) -> Column:
        return case(
            (F.coalesce(F.length(strip(value)), F.lit(0)) == 0, "EMPTY"),
            (iso == "", "UNRECOGNIZED_FORMAT"),
            (date.isNull(), "IMPOSSIBLE_DATE"),
            otherwise="PARSED",
        )

    def both(iso: Column) -> Column:
        date = F.try_to_date(F.when(~iso.startswith("0000"), iso), "yyyy-MM-dd")
        return let(date, lambda d: F.struct(d.alias("date"), status(iso, d).alias("status")))

    return let(iso_text(value), both)


def validate_parsed(field: Column, parsed: Column, today: Column) -> Column:
    """Verdict on an already parsed date: struct(status, parsed_iso, flags, note)."""
    d, st = parsed["date"], parsed["status"]
    ok = st == "PARSED"
    is_dob, is_expiry, is_issue = (
        field == "date_of_birth", field == "expiry_date", field == "issue_date",
    )
    far = ok & (d > F.add_months(today, 360))
    future = ok & (d > today)
    old = ok & is_dob & (F.datediff(today, d) / 365.25 > 120)
    expired = ok & is_expiry & (d < today)
    status = case(
        (st == "UNRECOGNIZED_FORMAT", "WARNING"),
        (~ok, "FAIL"),
        (is_issue & future, "FAIL"),
        (expired, "PASS"),
        (old, "WARNING"),
        (is_dob & future, "FAIL"),
        (far, "WARNING"),
        otherwise="PASS",
    )
    return F.struct(
        status.alias("status"),
        F.when(ok, F.date_format(d, "yyyy-MM-dd")).alias("parsed_iso"),
        flags(
            (st == "EMPTY", "empty"),
            (st == "UNRECOGNIZED_FORMAT", "unrecognized_format"),
            (st == "IMPOSSIBLE_DATE", "impossible_date"),
            (far, "far_future"),
            (is_dob & future, "dob_in_future"),
            (old, "implausible_age"),
            (expired, "expired"),
            (is_issue & future, "issue_in_future"),
        ).alias("flags"),
        F.when(expired, F.lit(EXPIRED_NOTE)).alias("note"),
    )


def validate_date(field: Column, value: Column, today: Column) -> Column:
    return let(parse_date(value), lambda p: validate_parsed(field, p, today))


def date_order_checks(dob: Column, issue: Column, expiry: Column) -> Column:
    """Array of struct(check, status) on the order of a document's three dates."""

    def check(name: str, status: str) -> Column:
        return F.struct(F.lit(name).alias("check"), F.lit(status).alias("status"))

    conflicts = F.array_compact(F.array(
        F.when(issue < dob, check("issue_after_dob", "FAIL")),
        F.when(expiry < issue, check("expiry_after_issue", "FAIL")),
        F.when(expiry < dob, check("expiry_after_dob", "WARNING")),
    ))
    any_date = F.coalesce(dob, issue, expiry).isNotNull()
    return F.when((F.size(conflicts) == 0) & any_date,
                  F.array(check("date_ordering", "PASS"))).otherwise(conflicts)
