"""Masking, dates, patterns and fields over labelled text."""

from pyspark.sql import functions as F

from idsieve.functions import dates, fields as ff, text as ft
from idsieve.functions.common import first_group
from idsieve.functions.fixed import LABEL_WORDS, PATTERNS, PROFILES
from idsieve.operators import fields as of, ocr
from idsieve.queries import inputs as I
from idsieve.queries.registry import query
from idsieve.sources.profiles import profiles, with_profile

BLANK = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

MASKED = """CASE
  WHEN length(v) = 0 THEN v
  WHEN k IN ('document_number','pan_number','passport_number','aadhaar_number','visa_number') THEN
    CASE WHEN length(v) <= 4 THEN repeat('X', length(v)) ELSE repeat('X', length(v) - 4) || right(v, 4) END
  WHEN k = 'address' THEN CASE WHEN length(v) <= 8 THEN 'XXXX'
    ELSE left(v, 3) || '…' || repeat('X', least(length(v) - 3, 8)) END
  WHEN k IN ('name', 'father_name') THEN array_to_string(list_transform(regexp_split_to_array(v, '\\s+'),
    lambda w: CASE WHEN length(w) <= 1 THEN 'X' ELSE left(w, 1) || repeat('X', length(w) - 1) END), ' ')
  WHEN k LIKE 'mrz%' THEN regexp_replace(upper(v), '[A-Z0-9]', 'X', 'g')
  WHEN k IN ('date_of_birth', 'issue_date', 'expiry_date') THEN regexp_replace(v, '\\d', 'X', 'g')
  ELSE v END"""


@query("mask_value", f"""
SELECT doc_id, field, {MASKED} AS masked
FROM (SELECT doc_id, field, lower(field) AS k, {BLANK.format('value')} AS v FROM ({I.FIELD_VALUES_SQL}) f) t""")
def q_mask_value(spark, sf):
    return I.derive(spark, sf, I.FIELD_VALUES).select(
        "doc_id", "field", ft.mask_value(F.col("field"), F.col("value")).alias("masked"))


@query("is_sensitive", f"""
SELECT field, sensitive, count(*) AS n FROM (
 SELECT field, lower(field) IN ('document_number','aadhaar_number','pan_number','passport_number','visa_number',
   'address','name','father_name') OR lower(field) LIKE 'mrz%' AS sensitive FROM ({I.FIELD_VALUES_SQL}) f) t
GROUP BY field, sensitive""")
def q_is_sensitive(spark, sf):
    return (I.derive(spark, sf, I.FIELD_VALUES)
            .groupBy("field", ft.is_sensitive(F.col("field")).alias("sensitive"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("normalize_text", """
SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
FROM documents""")
def q_normalize(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", ft.normalize_text(F.col("text")).alias("text"))


def iso_sql(v: str) -> str:
    """ISO text of a date string, '' for an unknown shape."""
    def g(p, i):
        return f"regexp_extract({v}, '{p}', {i})"
    a = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{4})$"
    b = r"^(\d{4})[/\-.](\d{2})[/\-.](\d{2})$"
    c = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{2})$"
    d = r"^(\d{2})\s([A-Za-z]{3})\s(\d{4})$"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    return f"""CASE WHEN {v} IS NULL THEN ''
      WHEN regexp_matches({v}, '{a}') THEN {g(a,3)} || '-' || {g(a,2)} || '-' || {g(a,1)}
      WHEN regexp_matches({v}, '{b}') THEN {g(b,1)} || '-' || {g(b,2)} || '-' || {g(b,3)}
      WHEN regexp_matches({v}, '{c}') THEN CASE WHEN {g(c,3)} >= '69' THEN '19' ELSE '20' END || {g(c,3)} || '-' || {g(c,2)} || '-' || {g(c,1)}
      WHEN regexp_matches({v}, '{d}') THEN {g(d,3)} || '-' || lpad(CAST(coalesce(list_position({months}, lower({g(d,2)})), 0) AS VARCHAR), 2, '0') || '-' || {g(d,1)}
      ELSE '' END"""


def date_sql(v: str) -> str:
    return f"try_cast({iso_sql(v)} AS DATE)"


DATES = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {v} AS value FROM ({I.ID_TEXT}) t" for f, v in (
        ("date_of_birth", "CASE WHEN doc_id % 41 = 0 THEN '01/01/1899' WHEN doc_id % 43 = 0 THEN '01/02/2031' "
                          "WHEN doc_id % 47 = 0 THEN '' WHEN doc_id % 53 = 0 THEN '1/2/1990' ELSE dob END"),
        ("issue_date", "CASE WHEN doc_id % 37 = 0 THEN '2031-05-06' ELSE issued END"),
        ("expiry_date", "CASE WHEN doc_id % 37 = 0 THEN '2071.05.06' ELSE expires END"),
    ))
DATES_SQL = I.plain(DATES)


@query("parse_date", f"""
SELECT doc_id, field, coalesce(CAST(d AS VARCHAR), '') AS iso,
  CASE WHEN value = '' THEN 'EMPTY' WHEN iso = '' THEN 'UNRECOGNIZED_FORMAT' WHEN d IS NULL THEN 'IMPOSSIBLE_DATE' ELSE 'PARSED' END AS status
FROM (SELECT doc_id, field, value, {iso_sql('value')} AS iso, {date_sql('value')} AS d FROM ({DATES_SQL}) t) u""")
def q_parse_date(spark, sf):
    p = dates.parse_date(F.col("value"))
    return I.derive(spark, sf, DATES).withColumn("p", p).select(
        "doc_id", "field", F.coalesce(F.date_format("p.date", "yyyy-MM-dd"), F.lit("")).alias("iso"),
        F.col("p.status").alias("status"))


def validated_sql(src: str) -> str:
    """Rows of src(doc_id, field, value) with date status, flags and note."""
    t = f"DATE '{I.TODAY}'"
    return f"""
SELECT *, CASE WHEN st = 'UNRECOGNIZED_FORMAT' THEN 'WARNING' WHEN st <> 'PARSED' THEN 'FAIL'
   WHEN field = 'issue_date' AND d > {t} THEN 'FAIL' WHEN field = 'expiry_date' AND d < {t} THEN 'PASS'
   WHEN field = 'date_of_birth' AND date_diff('day', d, {t}) / 365.25 > 120 THEN 'WARNING'
   WHEN field = 'date_of_birth' AND d > {t} THEN 'FAIL' WHEN d > {t} + INTERVAL 30 YEAR THEN 'WARNING' ELSE 'PASS' END AS status,
  concat_ws(',', CASE WHEN st = 'EMPTY' THEN 'empty' END, CASE WHEN st = 'UNRECOGNIZED_FORMAT' THEN 'unrecognized_format' END,
   CASE WHEN st = 'IMPOSSIBLE_DATE' THEN 'impossible_date' END,
   CASE WHEN d > {t} + INTERVAL 30 YEAR THEN 'far_future' END, CASE WHEN field = 'date_of_birth' AND d > {t} THEN 'dob_in_future' END,
   CASE WHEN field = 'date_of_birth' AND date_diff('day', d, {t}) / 365.25 > 120 THEN 'implausible_age' END,
   CASE WHEN field = 'expiry_date' AND d < {t} THEN 'expired' END, CASE WHEN field = 'issue_date' AND d > {t} THEN 'issue_in_future' END) AS flags
FROM (SELECT *, CASE WHEN value = '' THEN 'EMPTY' WHEN iso = '' THEN 'UNRECOGNIZED_FORMAT' WHEN d IS NULL THEN 'IMPOSSIBLE_DATE' ELSE 'PARSED' END AS st
 FROM (SELECT *, {iso_sql('value')} AS iso, {date_sql('value')} AS d FROM ({src}) v0) v1) v2"""


@query("validate_date", f"""
SELECT doc_id, field, status, coalesce(CAST(d AS VARCHAR), '') AS parsed_iso, flags,
  CASE WHEN flags LIKE '%expired%' THEN 1 ELSE 0 END AS has_note FROM ({validated_sql(DATES_SQL)}) v3""")
def q_validate_date(spark, sf):
    v = dates.validate_date(F.col("field"), F.col("value"), I.at(spark, I.TODAY))
    return I.derive(spark, sf, DATES).withColumn("v", v).select(
        "doc_id", "field", "v.status", F.coalesce("v.parsed_iso", F.lit("")).alias("parsed_iso"),
        F.array_join("v.flags", ",").alias("flags"),
        F.col("v.note").isNotNull().cast("int").alias("has_note"))


@query("fx_date_order", f"""
SELECT doc_id, u.chk AS "check", u.st AS status FROM (
 SELECT doc_id, unnest(CASE WHEN len(c) = 0 AND coalesce(b, i, e) IS NOT NULL THEN [{{'chk': 'date_ordering', 'st': 'PASS'}}] ELSE c END) AS u
 FROM (SELECT doc_id, b, i, e, list_filter([
   CASE WHEN i < b THEN {{'chk': 'issue_after_dob', 'st': 'FAIL'}} END,
   CASE WHEN e < i THEN {{'chk': 'expiry_after_issue', 'st': 'FAIL'}} END,
   CASE WHEN e < b THEN {{'chk': 'expiry_after_dob', 'st': 'WARNING'}} END], lambda x: x IS NOT NULL) AS c
  FROM (SELECT doc_id, {date_sql('dob')} AS b, {date_sql('issued')} AS i, {date_sql('expires')} AS e FROM ({I.ID_TEXT_SQL}) t) d) k) z""")
def q_date_order(spark, sf):
    docs = I.id_text(spark, sf).select(
        "doc_id", F.col("dob").alias("date_of_birth"), F.col("issued").alias("issue_date"),
        F.col("expires").alias("expiry_date"))
    return of.date_order(docs)


# The SQL engine's regular expressions have no look-behind, so the three name
# patterns are compared in the fields query instead.
PLAIN = [n for n in PATTERNS if "(?<!" not in PATTERNS[n]]
_sq = {n: p.replace("'", "''") for n, p in PATTERNS.items()}


@query("fx_patterns", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, {BLANK.format(f'''regexp_extract(full_text, '{_sq[n]}', 1)''')} AS found FROM ({I.ID_TEXT_SQL}) t WHERE regexp_matches(full_text, '{_sq[n]}')"
    for n in PLAIN))
def q_patterns(spark, sf):
    found = F.array(*[F.struct(F.lit(n).alias("pattern"),
                               first_group(F.col("full_text"), PATTERNS[n]).alias("found"))
                      for n in PLAIN])
    return I.id_text(spark, sf).select("doc_id", F.inline(found)).filter("found IS NOT NULL")


def rx(v: str, name: str) -> str:
    return f"nullif({BLANK.format(f'''regexp_extract({v}, '{_sq[name]}', 1)''')}, '')"


UP = "upper(full_text)"
NUMBER_SQL = f"""CASE document_type
 WHEN 'PAN' THEN coalesce({rx(UP, 'pan_label')}, {rx(UP, 'pan')})
 WHEN 'AADHAAR' THEN {rx('full_text', 'aadhaar')}
 WHEN 'PASSPORT' THEN coalesce({rx(UP, 'passport_label')}, {rx(UP, 'passport')})
 WHEN 'DRIVING_LICENCE' THEN coalesce({rx(UP, 'licence_label')}, {rx(UP, 'licence')})
 WHEN 'VISA' THEN coalesce({rx(UP, 'visa_number')}, {rx(UP, 'generic_id')}, {rx(UP, 'passport')})
 WHEN 'PERMIT' THEN coalesce({rx(UP, 'generic_id')}, {rx(UP, 'passport')}, {rx(UP, 'pan')})
 WHEN 'NATIONAL_ID' THEN coalesce({rx('full_text', 'aadhaar')}, {rx(UP, 'pan')}, {rx(UP, 'generic_id')})
 ELSE coalesce({rx('full_text', 'aadhaar')}, {rx(UP, 'pan')}, {rx(UP, 'passport')}, {rx(UP, 'licence')}) END"""


def shape_sql(t: str, v: str) -> str:
    u = f"upper(replace({v}, ' ', ''))"
    return f"""CASE WHEN CASE {t} WHEN 'PAN' THEN regexp_full_match({u}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')
  WHEN 'AADHAAR' THEN length(regexp_replace({u}, '\\D', '', 'g')) = 12
  WHEN 'PASSPORT' THEN regexp_full_match({u}, '[A-Z][0-9]{{7}}')
  WHEN 'DRIVING_LICENCE' THEN length(regexp_replace({u}, '[\\s\\-]', '', 'g')) >= 8
  WHEN 'VISA' THEN length({u}) >= 6 WHEN 'PERMIT' THEN length({u}) >= 6 WHEN 'NATIONAL_ID' THEN length({u}) >= 6
  ELSE length({u}) >= 4 END THEN 'PASS' ELSE 'WARNING' END"""


@query("fx_document_number", f"SELECT doc_id, document_type, {NUMBER_SQL} AS document_number FROM ({I.ID_TEXT_SQL}) t")
def q_document_number(spark, sf):
    return I.id_text(spark, sf).select(
        "doc_id", "document_type",
        ff.document_number(F.col("document_type"), F.col("full_text")).alias("document_number"))


@query("fx_number_shape", f"""
SELECT doc_id, document_type, {shape_sql('document_type', 'v')} AS shape
FROM (SELECT doc_id, document_type, CASE WHEN doc_id % 2 = 0 THEN num ELSE right(num, CAST(doc_id % 9 AS INT)) END AS v FROM ({I.ID_TEXT_SQL}) t) u""")
def q_number_shape(spark, sf):
    v = F.expr("CASE WHEN doc_id % 2 = 0 THEN num ELSE right(num, CAST(doc_id % 9 AS INT)) END")
    return I.id_text(spark, sf).select(
        "doc_id", "document_type", ff.number_shape(F.col("document_type"), v).alias("shape"))


_CONF = "CAST(doc_id * 37 % 101 AS DOUBLE) / 100.0"
_VALID = "CASE doc_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' ELSE 'FAIL' END"


@query("fx_status", f"""
SELECT doc_id, CASE WHEN c < 0.35 OR v = 'FAIL' THEN 'UNCERTAIN' ELSE 'EXTRACTED' END AS status
FROM (SELECT doc_id, {_CONF} AS c, {_VALID} AS v FROM documents) t""")
def q_status(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", ff.field_status(F.expr(_CONF), F.expr(_VALID)).alias("status"))


@query("fx_reconcile", f"""
SELECT doc_id, CASE WHEN c < 0.35 AND v = 'PASS' THEN 'WARNING' ELSE v END AS validation
FROM (SELECT doc_id, {_CONF} AS c, {_VALID} AS v FROM documents) t""")
def q_reconcile(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", ff.reconcile(F.expr(_CONF), F.expr(_VALID)).alias("validation"))


# --- whole field extraction -----------------------------------------------------

_NEXT = "(?is)[\\s,]+(?:" + "|".join(LABEL_WORDS) + ")\\b.*$"
_NAME = _sq["name_label"]
for _w in ("father", "mother", "husband"):
    _NAME = _NAME.replace(f"(?<!{_w}\\s)", "")
# Look-behind free: relatives' labels are blanked out before the name labels are tried.
_OWN = "regexp_replace(full_text, '(?i)(father|mother|husband)\\sname', '#', 'g')"


def person_sql(raw: str) -> str:
    cut = f"regexp_replace({raw}, '{_NEXT}', '')"
    one = f"regexp_replace(replace({cut}, ',', ' '), '\\s+', ' ', 'g')"
    return f"nullif({BLANK.format(one)}, '')"


_SEX = f"upper({rx('full_text', 'sex')})"
EXTRACT_SQL = f"""
SELECT doc_id, document_type, u.f AS field, u.v AS value, coalesce(u.r, u.v) AS raw_value, u.s AS validation FROM (
SELECT doc_id, document_type, unnest([
 {{'f': 'name', 'v': CASE WHEN p THEN coalesce(sur || ' ' || giv, giv, sur, lab) ELSE lab END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'document_number', 'v': CASE WHEN vno IS NULL THEN fno END, 'r': NULL, 's': {shape_sql('document_type', 'fno')}}},
 {{'f': 'passport_number', 'v': CASE WHEN p THEN fno END, 'r': NULL, 's': {shape_sql('document_type', 'fno')}}},
 {{'f': 'visa_number', 'v': vno, 'r': NULL, 's': {shape_sql("'VISA'", 'vno')}}},
 {{'f': 'father_name', 'v': CASE WHEN document_type = 'PAN' THEN {person_sql(rx('full_text', 'father_name'))} END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'date_of_birth', 'v': CASE WHEN p THEN coalesce(bi, b) ELSE b END, 'r': b, 's': CASE WHEN bl IS NULL AND NOT p AND bs = 'PASS' THEN 'WARNING' ELSE bs END}},
 {{'f': 'issue_date', 'v': CASE WHEN p THEN coalesce(ii, i) ELSE i END, 'r': i, 's': ist}},
 {{'f': 'expiry_date', 'v': CASE WHEN p THEN coalesce(ei, e) ELSE e END, 'r': e, 's': est}},
 {{'f': 'nationality', 'v': CASE WHEN p THEN left(upper(nat), 20) WHEN document_type IN ('VISA', 'PERMIT') AND lower(nat) NOT IN ('of', 'the', 'and', 'for') THEN nat END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'sex', 'v': CASE WHEN p THEN CASE WHEN sx LIKE 'M%' THEN 'M' WHEN sx LIKE 'F%' THEN 'F' ELSE sx END END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'gender', 'v': CASE WHEN document_type IN ('NATIONAL_ID', 'AADHAAR') THEN left(sx, 1) END, 'r': NULL, 's': CASE WHEN left(sx, 1) IN ('M', 'F') THEN 'PASS' ELSE 'WARNING' END}},
 {{'f': 'address', 'v': CASE WHEN document_type IN ('NATIONAL_ID', 'AADHAAR', 'DRIVING_LICENCE') THEN {rx('full_text', 'address')} END, 'r': NULL, 's': 'WARNING'}},
 {{'f': 'visa_type', 'v': CASE WHEN document_type = 'VISA' THEN {rx('full_text', 'visa_type')} END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'entries', 'v': CASE WHEN document_type = 'VISA' THEN {rx('full_text', 'entries')} END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'duration_of_stay', 'v': CASE WHEN document_type = 'VISA' THEN {rx('full_text', 'duration')} END, 'r': NULL, 's': 'PASS'}},
 {{'f': 'permit_type', 'v': CASE WHEN document_type = 'PERMIT' AND length({rx('full_text', 'permit_type')}) >= 3 THEN {rx('full_text', 'permit_type')} END, 'r': NULL, 's': 'WARNING'}}
]) AS u
FROM (SELECT *,
  (SELECT status FROM ({validated_sql("SELECT 'date_of_birth' AS field, b AS value")}) q) AS bs,
  (SELECT status FROM ({validated_sql("SELECT 'issue_date' AS field, i AS value")}) q) AS ist,
  (SELECT status FROM ({validated_sql("SELECT 'expiry_date' AS field, e AS value")}) q) AS est,
  CAST({date_sql('b')} AS VARCHAR) AS bi, CAST({date_sql('i')} AS VARCHAR) AS ii, CAST({date_sql('e')} AS VARCHAR) AS ei
 FROM (SELECT *, coalesce(bl, CASE WHEN document_type NOT IN ('PERMIT', 'UNKNOWN') THEN {rx('full_text', 'date')} END) AS b
  FROM (SELECT *, document_type = 'PASSPORT' AS p,
   {person_sql(rx('full_text', 'surname'))} AS sur, {person_sql(rx('full_text', 'given_names'))} AS giv,
   {person_sql(f"nullif(regexp_extract({_OWN}, '{_NAME}', 1), '')")} AS lab,
   {NUMBER_SQL} AS fno, CASE WHEN document_type = 'VISA' THEN {rx('full_text', 'visa_number')} END AS vno,
   {rx('full_text', 'dob_label')} AS bl, {rx('full_text', 'issue')} AS i, {rx('full_text', 'expiry')} AS e,
   {rx('full_text', 'nationality')} AS nat, {_SEX} AS sx FROM ({I.ID_TEXT_SQL}) t0) t1) t2) t3) t4
WHERE u.v IS NOT NULL"""


@query("fx_fields", f"SELECT doc_id, field, value, raw_value, validation FROM ({EXTRACT_SQL}) x")
def q_fields(spark, sf):
    return of.extract(I.id_text(spark, sf), I.at(spark, I.TODAY)).select(
        "doc_id", "field", "value", "raw_value", "validation")


@query("fx_passport_fields", f"""
SELECT field, validation, count(*) AS n, min(value) AS lowest, max(value) AS highest
FROM ({EXTRACT_SQL}) x WHERE document_type = 'PASSPORT' GROUP BY field, validation""")
def q_passport_fields(spark, sf):
    docs = I.id_text(spark, sf).filter("document_type = 'PASSPORT'")
    return (of.extract(docs, I.at(spark, I.TODAY)).groupBy("field", "validation")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"),
                 F.max("value").alias("highest")))


# --- profiles ----------------------------------------------------------------------

_PROFILE_SQL = "(VALUES " + ", ".join(
    f"('{t}', '{pid}', '{name}', {list(fs)!r}::VARCHAR[], {str(mrz).lower()}, '{'NATIONAL_ID' if t in ('PAN', 'AADHAAR') else t}', {i})"
    for i, (t, pid, name, fs, mrz) in enumerate(PROFILES)
) + ") AS p(document_type, profile_id, display_name, expected_fields, supports_mrz, category, type_ord)"


@query("src_profiles", f"""
SELECT p.document_type, profile_id, category, supports_mrz, len(expected_fields) AS n_expected, count(doc_id) AS n_docs
FROM {_PROFILE_SQL} LEFT JOIN ({I.ID_TEXT_SQL}) t ON t.document_type = p.document_type
GROUP BY ALL""")
def q_src_profiles(spark, sf):
    n = I.id_text(spark, sf).groupBy("document_type").agg(F.count("doc_id").alias("n_docs"))
    return profiles(spark).join(n, "document_type", "left").select(
        "document_type", "profile_id", "category", "supports_mrz",
        F.size("expected_fields").alias("n_expected"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


_MAYBE = "CASE WHEN doc_id % 23 = 0 THEN 'LIBRARY_CARD' ELSE document_type END"


@query("join_doc_profile", f"""
SELECT doc_id, profile_id, category, supports_mrz
FROM (SELECT doc_id, {_MAYBE} AS dt FROM ({I.ID_TEXT_SQL}) t) d
JOIN {_PROFILE_SQL} ON p.document_type = CASE WHEN dt = 'LIBRARY_CARD' THEN 'UNKNOWN' ELSE dt END""")
def q_join_doc_profile(spark, sf):
    docs = I.id_text(spark, sf).select("doc_id", F.expr(_MAYBE).alias("document_type"))
    return with_profile(docs).select("doc_id", "profile_id", "category", "supports_mrz")


# --- boxes ---------------------------------------------------------------------------

PASSES_SQL = f"""
SELECT doc_id, pass, pass_ord, avg(confidence) AS mc, count(*) AS n, avg(confidence) * ln(1 + count(*)) AS sc
FROM ({I.ID_BOXES_SQL}) b GROUP BY doc_id, pass, pass_ord"""
BEST_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, pass_ord) AS rn FROM ({PASSES_SQL}) p) r WHERE rn = 1"""
BOXES_SQL = f"SELECT b.* FROM ({I.ID_BOXES_SQL}) b JOIN ({BEST_SQL}) s ON b.doc_id = s.doc_id AND b.pass = s.pass"


@query("win_best_pass", f"SELECT doc_id, pass, round(mc, 4) AS mean_confidence, n AS box_count, round(sc, 4) AS score FROM ({BEST_SQL}) x")
def q_best_pass(spark, sf):
    return ocr.best_pass(I.id_boxes(spark, sf)).select(
        "doc_id", "pass", F.round("mean_confidence", 4).alias("mean_confidence"), "box_count",
        F.round("score", 4).alias("score"))


@query("agg_ocr_mean_conf", f"SELECT doc_id, round(avg(confidence), 4) AS mean_ocr_confidence, count(*) AS text_box_count FROM ({I.ID_BOXES_SQL}) b GROUP BY doc_id")
def q_mean_conf(spark, sf):
    return ocr.mean_confidence(I.id_boxes(spark, sf))


@query("join_box_merge", f"""
SELECT doc_id, pass, text, x, y, confidence FROM ({I.ID_BOXES_SQL}) a WHERE pass = 'contrast'
UNION ALL
SELECT doc_id, pass, text, x, y, confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, upper(text), x, y, w, h ORDER BY box_ord) AS rn
 FROM ({I.ID_BOXES_SQL}) s WHERE pass = 'binary' AND NOT EXISTS (
  SELECT 1 FROM ({I.ID_BOXES_SQL}) p WHERE p.pass = 'contrast' AND p.doc_id = s.doc_id AND upper(p.text) = upper(s.text))) z WHERE rn = 1""")
def q_box_merge(spark, sf):
    b = I.id_boxes(spark, sf)
    return ocr.merge_passes(b.filter("pass = 'contrast'"), b.filter("pass = 'binary'")).select(
        "doc_id", "pass", "text", "x", "y", "confidence")


LINES_SQL = """SELECT doc_id, block_num, line_num, string_agg(text, ' ' ORDER BY x, box_ord) AS line_text
FROM ({0}) b GROUP BY doc_id, block_num, line_num"""


@query("sort_reading_order", f"""SELECT doc_id, block_num, line_num, line_text, n AS line_ord, CASE WHEN n = 1 THEN string_agg(line_text, chr(10)) OVER (
  PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS full_text
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_num, line_num) AS n FROM ({LINES_SQL.format(BOXES_SQL)}) k) l""")
def q_reading_order(spark, sf):
    return ocr.reading_order(ocr.boxes_of_best_pass(I.id_boxes(spark, sf)))


@query("box_geometry", f"""
SELECT doc_id, pass, box_ord, w AS width, h AS height, CAST(floor(x + w / 2.0) AS INT) AS center_x, CAST(floor(y + h / 2.0) AS INT) AS center_y
FROM ({I.ID_BOXES_SQL}) b""")
def q_geometry(spark, sf):
    return ocr.geometry(I.id_boxes(spark, sf)).select(
        "doc_id", "pass", "box_ord", "width", "height", "center_x", "center_y")


PACK = "upper(regexp_replace({0}, '\\s+', '', 'g'))"
_PAIRS_SQL = f"""
SELECT f.doc_id, f.field, f.raw_value, b.box_ord, b.confidence, b.x, b.y, b.w, b.h,
  len(list_filter(regexp_extract_all(upper(f.raw_value), '[A-Z0-9]+'), lambda t: t = upper(b.text))) AS eq,
  list_position(regexp_extract_all(upper(f.raw_value), '[A-Z0-9]+'), upper(b.text)) AS pos,
  {PACK.format('b.text')} <> '' AND (contains({PACK.format('b.text')}, {PACK.format('f.raw_value')}) OR contains({PACK.format('f.raw_value')}, {PACK.format('b.text')})) AS cont
FROM ({EXTRACT_SQL}) f JOIN ({BOXES_SQL}) b ON b.doc_id = f.doc_id"""
CONF_SQL = f"""
SELECT x.doc_id, x.document_type, x.field, x.value, x.raw_value, x.validation AS v0, coalesce(round(CASE WHEN n > 0 THEN s / n ELSE c END, 4), 0.0) AS ocr_confidence
FROM ({EXTRACT_SQL}) x LEFT JOIN (
 SELECT doc_id, field, sum(eq * confidence) AS s, sum(eq) AS n, avg(confidence) FILTER (WHERE cont) AS c
 FROM ({_PAIRS_SQL}) p GROUP BY doc_id, field) g ON g.doc_id = x.doc_id AND g.field = x.field"""


def _assessed(spark, sf):
    docs = I.id_text(spark, sf)
    boxes = ocr.boxes_of_best_pass(I.id_boxes(spark, sf))
    return docs, of.assess(of.extract(docs, I.at(spark, I.TODAY)), boxes)


@query("join_field_box_conf", f"SELECT doc_id, field, ocr_confidence FROM ({CONF_SQL}) c")
def q_field_conf(spark, sf):
    return _assessed(spark, sf)[1].select("doc_id", "field", "ocr_confidence")


@query("join_field_box_bbox", f"""
SELECT doc_id, field, x, y, w, h FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY CASE WHEN cont THEN 0 ELSE 1 END, CASE WHEN cont THEN 0 ELSE pos END, box_ord) AS rn
 FROM ({_PAIRS_SQL}) p WHERE cont OR eq > 0) r WHERE rn = 1""")
def q_field_bbox(spark, sf):
    return _assessed(spark, sf)[1].filter("bbox IS NOT NULL").select("doc_id", "field", "bbox.*")


@query("fx_source_region", f"""
SELECT doc_id, pass, box_ord, x, y, x + w AS x2, y + h AS y2 FROM ({I.ID_BOXES_SQL}) b""")
def q_source_region(spark, sf):
    b = I.id_boxes(spark, sf).withColumn("bbox", F.struct("x", "y", "w", "h"))
    reg = b.withColumn("r", ff.source_region(F.col("bbox")))
    return reg.select("doc_id", "pass", "box_ord", "r.x", "r.y", "r.x2", "r.y2")


ASSESSED_SQL = f"""
SELECT *, CASE WHEN ocr_confidence < 0.35 OR validation = 'FAIL' THEN 'UNCERTAIN' ELSE 'EXTRACTED' END AS status
FROM (SELECT *, CASE WHEN ocr_confidence < 0.35 AND v0 = 'PASS' THEN 'WARNING' ELSE v0 END AS validation FROM ({CONF_SQL}) c0) c1"""

# Twice the same field from two extractors: the labelled one (ord 1) wins.
_DUP = f"""SELECT doc_id, 'name' AS field, holder AS value, 2 AS ord FROM ({I.ID_TEXT}) a WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'name' AS field, upper(holder) AS value, 1 AS ord FROM ({I.ID_TEXT}) b WHERE doc_id % 2 = 0"""


@query("win_first_field", f"""
SELECT doc_id, field, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) AS rn FROM ({I.plain(_DUP)}) d) r WHERE rn = 1""")
def q_first_field(spark, sf):
    return of.first_of_each(I.derive(spark, sf, _DUP)).select("doc_id", "field", "value", "ord")


COMPLETE_SQL = f"""
SELECT doc_id, field_count, uncertain_count, pass_count, warn_count, fail_count, applicable_count, extracted_count, missing,
 mean_field_ocr_confidence, fc AS field_completeness,
 CASE WHEN field_count = 0 THEN 'NO_FIELDS' WHEN fc >= 0.6 AND uncertain_count = 0 THEN 'OK' ELSE 'PARTIAL' END AS fields_status
FROM (SELECT *, CASE WHEN applicable_count = 0 THEN 0.0 ELSE round(extracted_count / applicable_count, 4) END AS fc
FROM (SELECT d.doc_id, coalesce(field_count, 0) AS field_count, coalesce(uc, 0) AS uncertain_count, coalesce(pc, 0) AS pass_count,
  coalesce(wc, 0) AS warn_count, coalesce(fl, 0) AS fail_count, mean_field_ocr_confidence, len(need) AS applicable_count,
  len(list_filter(need, lambda f: list_contains(okk, f) OR (f = 'gender' AND list_contains(okk, 'sex')) OR (f = 'sex' AND list_contains(okk, 'gender')) OR (f = 'document_number' AND list_contains(okk, 'visa_number')))) AS extracted_count,
  array_to_string(list_filter(need, lambda f: NOT (list_contains(fnd, f) OR (f = 'gender' AND list_contains(fnd, 'sex')) OR (f = 'sex' AND list_contains(fnd, 'gender')) OR (f = 'document_number' AND list_contains(fnd, 'visa_number')))), ',') AS missing
 FROM (SELECT t.doc_id, list_filter(expected_fields, lambda f: f NOT IN ('photo', 'signature', 'mrz')) AS need FROM ({I.ID_TEXT_SQL}) t JOIN {_PROFILE_SQL} ON p.document_type = t.document_type) d
 LEFT JOIN (SELECT doc_id, count(*) AS field_count, count_if(status = 'UNCERTAIN') AS uc, count_if(validation = 'PASS') AS pc,
   count_if(validation = 'WARNING') AS wc, count_if(validation = 'FAIL') AS fl, round(avg(ocr_confidence) + 1e-9, 4) AS mean_field_ocr_confidence,
   list(field) AS fnd0, list(field) FILTER (WHERE status = 'EXTRACTED') AS okk0 FROM ({ASSESSED_SQL}) a GROUP BY doc_id) g ON g.doc_id = d.doc_id
 CROSS JOIN LATERAL (SELECT coalesce(fnd0, []::VARCHAR[]) AS fnd, coalesce(okk0, []::VARCHAR[]) AS okk) z) s) y"""


@query("agg_field_completeness", f"""
SELECT doc_id, field_count, uncertain_count, pass_count, warn_count, fail_count, applicable_count, extracted_count,
 mean_field_ocr_confidence, field_completeness, fields_status FROM ({COMPLETE_SQL}) c""")
def q_completeness(spark, sf):
    docs, found = _assessed(spark, sf)
    return of.summarize(docs, found).drop("document_type", "missing_expected_fields")


@query("set_missing_fields", f"SELECT doc_id, missing FROM ({COMPLETE_SQL}) c")
def q_missing(spark, sf):
    docs, found = _assessed(spark, sf)
    return of.summarize(docs, found).select(
        "doc_id", F.array_join("missing_expected_fields", ",").alias("missing"))


@query("join_expected_fields", f"""
SELECT d.doc_id, d.field, CASE WHEN d.field IN ('photo', 'signature', 'mrz') THEN 'NOT_APPLICABLE' WHEN a.status IS NULL THEN 'MISSING' ELSE a.status END AS status,
  coalesce(a.validation, '') AS validation
FROM (SELECT t.doc_id, unnest(expected_fields) AS field FROM ({I.ID_TEXT_SQL}) t JOIN {_PROFILE_SQL} ON p.document_type = t.document_type) d
LEFT JOIN ({ASSESSED_SQL}) a ON a.doc_id = d.doc_id AND a.field = d.field""")
def q_inventory(spark, sf):
    docs, found = _assessed(spark, sf)
    return of.inventory(docs, found).select(
        "doc_id", "field", "status", F.coalesce("validation", F.lit("")).alias("validation"))


@query("public_projection", f"""
SELECT doc_id, left(text, 500) AS text_preview, n_chars FROM documents""")
def q_public(spark, sf):
    docs = I.table(spark, sf, "documents").withColumn("_embedding", F.lit(None).cast("array<float>"))
    from idsieve.operators.intake import public_projection
    return public_projection(docs.withColumnRenamed("text", "full_text")).select(
        "doc_id", "text_preview", "n_chars")
