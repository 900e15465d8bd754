"""Machine-readable zone (ICAO 9303) as Column expressions over line arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idsieve.functions.common import case, let, strip
from idsieve.functions.dates import parse_date

# Fixed values.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
FILLER_COMPAT_VALUE = 36
WINDOW_LENGTHS = (44, 36, 30)
MIN_LINE, MAX_LINE, MIN_FILLERS = 20, 44, 2


def check_digit(data: Column, compat: bool = False) -> Column:
    """Weighted sum modulo 10; a filler counts 0 (36 with ``compat``), unknown characters 0."""

    def value(ch: Column) -> Column:
        v = F.greatest(F.instr(F.lit(DIGITS), ch) - 1, F.lit(0))
        return F.when(ch == "<", F.lit(FILLER_COMPAT_VALUE)).otherwise(v) if compat else v

    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    terms = F.transform(
        F.split(F.upper(data), ""),
        lambda ch, i: value(ch) * F.element_at(weights, (i % 3 + 1).cast("int")),
    )
    return (F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10).cast("string")


def digit_ok(data: Column, digit: Column, compat: bool = False) -> Column:
    return digit.rlike("^[0-9]$") & (check_digit(data, compat) == digit)


def _fillers(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("<")))


def line_candidates(text: Column) -> Column:
    """Cleaned text lines that look like MRZ lines, in text order."""
    cleaned = F.transform(
        F.split(F.upper(text), r"[\r\n]+"), lambda s: F.regexp_replace(s, "[^A-Z0-9<]", "")
    )
    return F.filter(
        cleaned,
        lambda s: F.length(s).between(MIN_LINE, MAX_LINE) & (_fillers(s) >= MIN_FILLERS),
    )


def window_candidates(text: Column) -> Column:
    """Consecutive 44/36/30-character windows of the collapsed text."""
    collapsed = F.regexp_replace(F.upper(text), "[^A-Z0-9<]", "")
    cuts = [
        F.regexp_extract_all(collapsed, F.lit("[A-Z0-9<]{%d}" % n), 0) for n in WINDOW_LENGTHS
    ]
    return F.filter(F.concat(*cuts), lambda s: _fillers(s) >= MIN_FILLERS)


def candidates(text: Column) -> Column:
    """Lines and windows, ordered and distinct."""
    return F.array_distinct(F.concat(line_candidates(text), window_candidates(text)))


def passport_first(lines: Column) -> Column:
    """Lines starting with P come first; order is otherwise kept."""
    return F.concat(
        F.filter(lines, lambda s: s.startswith("P")),
        F.filter(lines, lambda s: ~s.startswith("P")),
    )


def _select(c: Column) -> Column:
    """The decision over struct(td3, td2, td1, all)."""
    td3, td2, td1, cands = c["td3"], c["td2"], c["td1"], c["all"]
    outcome = case(
        ((F.size(td3) >= 2) | (F.size(td2) >= 2) | (F.size(td1) >= 3), "parsed"),
        (F.size(cands) > 0, "partial"), otherwise="none",
    )
    fmt = case((F.size(td3) >= 2, "TD3"), (F.size(td2) >= 2, "TD2"), (F.size(td1) >= 3, "TD1"))
    lines = case(
        (F.size(td3) >= 2, F.slice(td3, 1, 2)),
        (F.size(td2) >= 2, F.slice(td2, 1, 2)),
        (F.size(td1) >= 3, F.slice(td1, 1, 3)),
        otherwise=F.slice(cands, 1, 3),
    )
    return F.struct(outcome.alias("outcome"), fmt.alias("format"), lines.alias("lines"))


def select_lines(cands: Column) -> Column:
    """struct(outcome, format, lines): parsed with 2x44, 2x36 or 3x30 lines, else partial/none."""

    def by_length(c: Column) -> Column:
        def of(n: int) -> Column:
            return F.filter(c, lambda s: F.length(s) == n)

        return F.struct(passport_first(of(44)).alias("td3"), of(36).alias("td2"),
                        of(30).alias("td1"), c.alias("all"))

    return let(let(cands, by_length), _select)


def names(block: Column) -> Column:
    """struct(surname, given_names) of a name block."""
    parts = F.split(block, "<<", 2)
    return F.struct(
        strip(F.translate(F.get(parts, 0), "<", " ")).alias("surname"),
        strip(F.translate(F.coalesce(F.get(parts, 1), F.lit("")), "<", " ")).alias("given_names"),
    )


# Character offsets, as (line number, 1-based start, length).
LAYOUTS = {
    "TD3": {
        "names": (1, 6, 39), "number": (2, 1, 9), "number_cd": (2, 10, 1),
        "nationality": (2, 11, 3), "dob": (2, 14, 6), "dob_cd": (2, 20, 1), "sex": (2, 21, 1),
        "expiry": (2, 22, 6), "expiry_cd": (2, 28, 1), "optional": (2, 29, 14),
        "optional_cd": (2, 43, 1), "composite_cd": (2, 44, 1),
        "composite": ((2, 1, 10), (2, 14, 7), (2, 22, 22)), "width": 44, "count": 2,
    },
    "TD2": {
        "names": (1, 6, 31), "number": (2, 1, 9), "number_cd": (2, 10, 1),
        "nationality": (2, 11, 3), "dob": (2, 14, 6), "dob_cd": (2, 20, 1), "sex": (2, 21, 1),
        "expiry": (2, 22, 6), "expiry_cd": (2, 28, 1), "optional": (2, 29, 7),
        "optional_cd": None, "composite_cd": (2, 36, 1),
        "composite": ((2, 1, 10), (2, 14, 7), (2, 22, 14)), "width": 36, "count": 2,
    },
    "TD1": {
        "names": (3, 1, 30), "number": (1, 6, 9), "number_cd": (1, 15, 1),
        "nationality": (2, 16, 3), "dob": (2, 1, 6), "dob_cd": (2, 7, 1), "sex": (2, 8, 1),
        "expiry": (2, 9, 6), "expiry_cd": (2, 15, 1), "optional": (1, 16, 15),
        "optional_cd": None, "composite_cd": (2, 30, 1),
        "composite": ((1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)), "width": 30, "count": 3,
    },
}

PARSED_TYPE = (
    "struct<document_type_code:string,issuer:string,surname:string,given_names:string,"
    "document_number:string,nationality:string,dob:string,sex:string,expiry:string,"
    "number_ok:boolean,dob_ok:boolean,expiry_ok:boolean,optional_ok:boolean,"
    "composite_ok:boolean,structure_valid:boolean>"
)


def parse_layout(lines: Column, fmt: str, compat: bool = False) -> Column:
    """Fields and check digits of one layout, read at its fixed offsets."""
    lay = LAYOUTS[fmt]

    def cut(at) -> Column:
        return F.substring(F.get(lines, at[0] - 1), at[1], at[2])

    def bare(c: Column) -> Column:
        return F.replace(c, F.lit("<"))

    who = names(cut(lay["names"]))
    opt_cd = cut(lay["optional_cd"]) if lay["optional_cd"] else F.lit(None).cast("string")
    composite = F.concat(*[cut(a) for a in lay["composite"]])
    widths_ok = F.forall(lines, lambda s: F.length(s) == lay["width"])
    return F.struct(
        bare(F.substring(F.get(lines, 0), 1, 2)).alias("document_type_code"),
        bare(F.substring(F.get(lines, 0), 3, 3)).alias("issuer"),
        who["surname"].alias("surname"),
        who["given_names"].alias("given_names"),
        bare(cut(lay["number"])).alias("document_number"),
        bare(cut(lay["nationality"])).alias("nationality"),
        cut(lay["dob"]).alias("dob"),
        bare(cut(lay["sex"])).alias("sex"),
        cut(lay["expiry"]).alias("expiry"),
        digit_ok(cut(lay["number"]), cut(lay["number_cd"]), compat).alias("number_ok"),
        digit_ok(cut(lay["dob"]), cut(lay["dob_cd"]), compat).alias("dob_ok"),
        digit_ok(cut(lay["expiry"]), cut(lay["expiry_cd"]), compat).alias("expiry_ok"),
        F.when(opt_cd.rlike("^[0-9]$"),
               check_digit(cut(lay["optional"]), compat) == opt_cd).alias("optional_ok"),
        digit_ok(composite, cut(lay["composite_cd"]), compat).alias("composite_ok"),
        (widths_ok & (F.size(lines) == lay["count"])).alias("structure_valid"),
    ).cast(PARSED_TYPE)


def parse_selected(selected: Column, compat: bool = False) -> Column:
    """Parsed struct of the selected layout; null unless the outcome is ``parsed``."""
    return let(selected, lambda sel: case(
        *[(sel["format"] == fmt, parse_layout(sel["lines"], fmt, compat)) for fmt in LAYOUTS],
        otherwise=F.lit(None).cast(PARSED_TYPE),
    ))


def all_digits_ok(p: Column) -> Column:
    return (
        p["number_ok"] & p["dob_ok"] & p["expiry_ok"]
        & F.coalesce(p["optional_ok"], F.lit(True)) & p["composite_ok"]
    )


def letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")


def name_tokens(c: Column) -> Column:
    """Distinct upper-case tokens of two letters or more."""
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\s,]+"), letters)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def token_overlap(visible: Column, mrz: Column) -> Column:
    return let(mrz, lambda m: F.size(F.array_intersect(visible, m)) / F.greatest(F.lit(1), F.size(m)))


def compare_name(surname: Column, given: Column, visible: Column) -> Column:
    both = F.struct(
        letters(F.concat_ws(" ", surname, given)).alias("m"), letters(visible).alias("v"),
        token_overlap(name_tokens(visible),
                      F.array_union(name_tokens(surname), name_tokens(given))).alias("share"),
    )
    return let(both, lambda b: case(
        ((F.length(b["v"]) == 0) | (F.length(b["m"]) == 0), "NOT_ASSESSED"),
        (F.contains(b["v"], b["m"]) | F.contains(b["m"], b["v"]), "PASS"),
        (b["share"] >= 0.5, "PASS"),
        (b["share"] > 0, "WARNING"),
        otherwise="FAIL",
    ))


def visible_yymmdd(value: Column) -> Column:
    parsed = parse_date(value)["date"]
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")
    return F.coalesce(F.date_format(parsed, "yyMMdd"), F.when(F.length(digits) == 6, digits))


def compare_dob(mrz_dob: Column, visible: Column) -> Column:
    return let(visible_yymmdd(visible), lambda vis: case(
        (vis.isNull() | F.coalesce(F.length(mrz_dob) != 6, F.lit(True)), "NOT_ASSESSED"),
        (vis == mrz_dob, "PASS"),
        otherwise="FAIL",
    ))


def compare_number(mrz_number: Column, visible: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")

    both = F.struct(norm(mrz_number).alias("m"), norm(visible).alias("v"))
    return let(both, lambda b: case(
        ((b["m"] == "") | (b["v"] == ""), "NOT_ASSESSED"),
        (F.contains(b["v"], b["m"]) | F.contains(b["m"], b["v"]), "PASS"),
        otherwise="FAIL",
    ))


# Checklist items and labels.
CHECKLIST = (
    ("format_valid", "Format valid"),
    ("check_digits_valid", "Check digits valid"),
    ("name_consistency", "Name consistency"),
    ("dob_consistency", "DOB consistency"),
    ("document_number_consistency", "Document number consistency"),
)


def tri(c: Column) -> Column:
    return case((c.isNull(), "NOT_ASSESSED"), (c, "PASS"), otherwise="FAIL")


def checklist(statuses: list[Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(item).alias("item"), F.lit(label).alias("label"), st.alias("status"))
        for (item, label), st in zip(CHECKLIST, statuses)
    ])
