"""MRZ queries over lines built from customers."""

from pyspark.sql import functions as F

from idsieve.functions import mrz as m
from idsieve.operators import mrz as om
from idsieve.queries import inputs as I
from idsieve.queries.registry import query
from idsieve.queries.text import date_sql

T = I.MRZ_TEXT_SQL
DIG = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cd(v: str) -> str:
    return (f"CAST(list_sum(list_transform(range(1, length({v}) + 1), lambda i: greatest(instr('{DIG}', substr({v}, i, 1)) - 1, 0)"
            f" * CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)) % 10 AS INTEGER)::VARCHAR")


def ok(v: str, d: str) -> str:
    return f"(regexp_full_match({d}, '[0-9]') AND {cd(v)} = {d})"


LINES = "list_filter(list_transform(regexp_split_to_array(upper(full_text), '[\\r\\n]+'), lambda s: regexp_replace(s, '[^A-Z0-9<]', '', 'g')), lambda s: length(s) BETWEEN 20 AND 44 AND length(s) - length(replace(s, '<', '')) >= 2)"
COLLAPSED = "regexp_replace(upper(full_text), '[^A-Z0-9<]', '', 'g')"
WINDOWS = "list_filter(" + " || ".join(f"regexp_extract_all({COLLAPSED}, '[A-Z0-9<]{{{n}}}')" for n in (44, 36, 30)) + ", lambda s: length(s) - length(replace(s, '<', '')) >= 2)"


def dedupe(v: str) -> str:
    return f"list_filter({v}, lambda s, i: list_position({v}, s) = i)"


CANDS_SQL = f"SELECT *, {dedupe('ls')} AS lc, {dedupe('(ls || ws)')} AS bc FROM (SELECT *, {LINES} AS ls, {WINDOWS} AS ws FROM ({T}) t0) t1"


def sel(c: str) -> str:
    def of(n):
        return f"list_filter({c}, lambda s: length(s) = {n})"
    return f"""CASE WHEN len({of(44)}) >= 2 THEN {{'o': 'parsed', 'f': 'TD3', 'l': (list_filter({of(44)}, lambda s: starts_with(s, 'P')) || list_filter({of(44)}, lambda s: NOT starts_with(s, 'P')))[1:2]}}
 WHEN len({of(36)}) >= 2 THEN {{'o': 'parsed', 'f': 'TD2', 'l': {of(36)}[1:2]}}
 WHEN len({of(30)}) >= 3 THEN {{'o': 'parsed', 'f': 'TD1', 'l': {of(30)}[1:3]}}
 WHEN len({c}) > 0 THEN {{'o': 'partial', 'f': NULL, 'l': {c}[1:3]}} ELSE {{'o': 'none', 'f': NULL, 'l': []::VARCHAR[]}} END"""


SEL_SQL = f"SELECT *, CASE WHEN s1.o = 'parsed' THEN s1 ELSE s2 END AS s FROM (SELECT *, {sel('lc')} AS s1, {sel('bc')} AS s2 FROM ({CANDS_SQL}) c0) c1"


@query("mrz_check_digit", f"SELECT doc_id, document_number, {cd('document_number')} AS digit FROM (SELECT doc_id, replace(num, ' ', '<') AS document_number FROM ({I.ID_TEXT_SQL}) t) u")
def q_check_digit(spark, sf):
    n = F.replace(F.col("num"), F.lit(" "), F.lit("<"))
    return I.id_text(spark, sf).select(
        "doc_id", n.alias("document_number"), m.check_digit(n).alias("digit"))


@query("mrz_candidates", f"SELECT doc_id, len(lc) AS n_lines, array_to_string(lc, '|') AS lines FROM ({CANDS_SQL}) c")
def q_candidates(spark, sf):
    lines = F.array_distinct(m.line_candidates(F.col("full_text")))
    return I.mrz_text(spark, sf).withColumn("lc", lines).select(
        "doc_id", F.size("lc").alias("n_lines"), F.array_join("lc", "|").alias("lines"))


@query("set_mrz_candidates", f"SELECT doc_id, len(bc) AS n_candidates, array_to_string(bc, '|') AS candidates FROM ({CANDS_SQL}) c")
def q_set_candidates(spark, sf):
    return I.mrz_text(spark, sf).withColumn("bc", m.candidates(F.col("full_text"))).select(
        "doc_id", F.size("bc").alias("n_candidates"), F.array_join("bc", "|").alias("candidates"))


@query("mrz_select", f"SELECT doc_id, s.o AS outcome, coalesce(s.f, '') AS format, len(s.l) AS n_lines FROM ({SEL_SQL}) z")
def q_select(spark, sf):
    return om.select(I.mrz_text(spark, sf)).select(
        "doc_id", "selected.outcome", F.coalesce("selected.format", F.lit("")).alias("format"),
        F.size("selected.lines").alias("n_lines"))


@query("sort_mrz_lines", f"""
SELECT doc_id, array_to_string(list_filter(ls, lambda s: starts_with(s, 'P')) || list_filter(ls, lambda s: NOT starts_with(s, 'P')), '|') AS lines
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_reverse(ls) ELSE ls END AS ls FROM ({CANDS_SQL}) c) d""")
def q_sort_lines(spark, sf):
    ls = m.line_candidates(F.col("full_text"))
    return I.mrz_text(spark, sf).withColumn("ls", ls).withColumn(
        "ls", F.when(F.col("doc_id") % 2 == 0, F.reverse("ls")).otherwise(F.col("ls"))).select(
        "doc_id", F.array_join(m.passport_first(F.col("ls")), "|").alias("lines"))


def bare(x: str) -> str:
    return f"replace({x}, '<', '')"


def nm(block: str) -> tuple[str, str]:
    sp = f"instr({block}, '<<')"
    sur = f"trim(replace(CASE WHEN {sp} > 0 THEN left({block}, {sp} - 1) ELSE {block} END, '<', ' '))"
    giv = f"trim(replace(CASE WHEN {sp} > 0 THEN substr({block}, {sp} + 2) ELSE '' END, '<', ' '))"
    return sur, giv


def parsed_sql(fmt: str) -> str:
    l1, l2, l3 = "s.l[1]", "s.l[2]", "s.l[3]"

    def c(line, a, n):
        return f"substr({line}, {a}, {n})"
    if fmt == "TD1":
        block, num, ncd = c(l3, 1, 30), c(l1, 6, 9), c(l1, 15, 1)
        nat, dob, dcd, sex, exp, ecd = c(l2, 16, 3), c(l2, 1, 6), c(l2, 7, 1), c(l2, 8, 1), c(l2, 9, 6), c(l2, 15, 1)
        opt = "CAST(NULL AS BOOLEAN)"
        comp, ccd = f"({c(l1, 6, 25)} || {c(l2, 1, 7)} || {c(l2, 9, 7)} || {c(l2, 19, 11)})", c(l2, 30, 1)
    else:
        w = 44 if fmt == "TD3" else 36
        block, num, ncd = c(l1, 6, w - 5), c(l2, 1, 9), c(l2, 10, 1)
        nat, dob, dcd, sex, exp, ecd = c(l2, 11, 3), c(l2, 14, 6), c(l2, 20, 1), c(l2, 21, 1), c(l2, 22, 6), c(l2, 28, 1)
        if fmt == "TD3":
            opt = f"CASE WHEN regexp_full_match({c(l2, 43, 1)}, '[0-9]') THEN {cd(c(l2, 29, 14))} = {c(l2, 43, 1)} END"
            comp, ccd = f"({c(l2, 1, 10)} || {c(l2, 14, 7)} || {c(l2, 22, 22)})", c(l2, 44, 1)
        else:
            opt = "CAST(NULL AS BOOLEAN)"
            comp, ccd = f"({c(l2, 1, 10)} || {c(l2, 14, 7)} || {c(l2, 22, 14)})", c(l2, 36, 1)
    sur, giv = nm(block)
    return f"""SELECT *, {bare(c(l1, 1, 2))} AS code, {bare(c(l1, 3, 3))} AS issuer, {sur} AS surname, {giv} AS given_names,
 {bare(num)} AS document_number, {bare(nat)} AS nationality, {dob} AS dob, {bare(sex)} AS sex, {exp} AS expiry,
 {ok(num, ncd)} AS number_ok, {ok(dob, dcd)} AS dob_ok, {ok(exp, ecd)} AS expiry_ok, {opt} AS optional_ok, {ok(comp, ccd)} AS composite_ok
 FROM ({SEL_SQL}) z WHERE s.f = '{fmt}'"""


_OUT = ["code", "issuer", "surname", "given_names", "document_number", "nationality", "dob", "sex", "expiry"]
_CHECKS = ["number_ok", "dob_ok", "expiry_ok", "composite_ok"]


def _parse_query(fmt):
    cols = ", ".join(_OUT + _CHECKS)

    @query(f"mrz_parse_{fmt.lower()}", f"SELECT doc_id, {cols}, coalesce(CAST(optional_ok AS VARCHAR), 'n/a') AS optional_ok FROM ({parsed_sql(fmt)}) p")
    def run(spark, sf):
        p = om.parse(I.mrz_text(spark, sf)).filter(F.col("selected.format") == fmt)
        return p.select(
            "doc_id", F.col("parsed.document_type_code").alias("code"),
            *[F.col(f"parsed.{c}") for c in _OUT[1:] + _CHECKS],
            F.coalesce(F.col("parsed.optional_ok").cast("string"), F.lit("n/a")).alias("optional_ok"))
    return run


for _fmt in ("TD3", "TD2", "TD1"):
    _parse_query(_fmt)

PARSED = " UNION ALL ".join(f"SELECT * FROM ({parsed_sql(f)}) p{f}" for f in ("TD3", "TD2", "TD1"))


def letters(v):
    return f"regexp_replace(upper(coalesce({v}, '')), '[^A-Z]', '', 'g')"


def toks(v):
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({v}, ''), '[\\s,]+'), lambda w: {letters('w')}), lambda w: length(w) >= 2))"


NAME_CMP = """CASE WHEN vn = '' OR mn = '' THEN 'NOT_ASSESSED' WHEN contains(vn, mn) OR contains(mn, vn) THEN 'PASS'
 WHEN len(list_intersect(vt, mt)) / greatest(1, len(mt)) >= 0.5 THEN 'PASS' WHEN len(list_intersect(vt, mt)) > 0 THEN 'WARNING' ELSE 'FAIL' END"""
_VD = f"coalesce(strftime({date_sql('vis_dob')}, '%y%m%d'), CASE WHEN length(regexp_replace(vis_dob, '\\D', '', 'g')) = 6 THEN regexp_replace(vis_dob, '\\D', '', 'g') END)"


def alnum(v):
    return f"regexp_replace(upper(coalesce({v}, '')), '[^A-Z0-9]', '', 'g')"


CMP_SQL = f"""
SELECT *, {NAME_CMP} AS name_cmp, CASE WHEN vd IS NULL THEN 'NOT_ASSESSED' WHEN vd = dob THEN 'PASS' ELSE 'FAIL' END AS dob_cmp,
 CASE WHEN {alnum('vis_number')} = '' OR {alnum('document_number')} = '' THEN 'NOT_ASSESSED' WHEN contains({alnum('vis_number')}, {alnum('document_number')}) OR contains({alnum('document_number')}, {alnum('vis_number')}) THEN 'PASS' ELSE 'FAIL' END AS number_cmp
FROM (SELECT *, {letters('vis_name')} AS vn, {letters("surname || ' ' || given_names")} AS mn, {toks('vis_name')} AS vt, {toks("surname || ' ' || given_names")} AS mt, {_VD} AS vd FROM ({PARSED}) p) q"""


@query("mrz_names", f"SELECT doc_id, surname, given_names FROM ({PARSED}) p")
def q_names(spark, sf):
    return om.parse(I.mrz_text(spark, sf)).filter("parsed IS NOT NULL").select(
        "doc_id", "parsed.surname", "parsed.given_names")


def _compared(spark, sf):
    return om.compare(om.parse(I.mrz_text(spark, sf))).filter("parsed IS NOT NULL")


for _name, _col in (("mrz_cmp_name", "name_cmp"), ("mrz_cmp_dob", "dob_cmp"), ("mrz_cmp_docnum", "number_cmp")):
    query(_name, f"SELECT doc_id, {_col} FROM ({CMP_SQL}) c")(
        lambda spark, sf, c=_col: _compared(spark, sf).select("doc_id", c))


@query("set_name_tokens", f"SELECT doc_id, len(list_intersect(vt, mt)) AS common, round(len(list_intersect(vt, mt)) / greatest(1, len(mt)), 4) AS overlap FROM ({CMP_SQL}) c")
def q_tokens(spark, sf):
    v, t = m.name_tokens(F.col("vis_name")), F.array_union(
        m.name_tokens(F.col("parsed.surname")), m.name_tokens(F.col("parsed.given_names")))
    return _compared(spark, sf).withColumns({"v": v, "t": t}).select(
        "doc_id", F.size(F.array_intersect("v", "t")).alias("common"),
        F.round(m.token_overlap(F.col("v"), F.col("t")), 4).alias("overlap"))


# join_mrz_visible: the visible values come from the extracted fields of the same customer.
_VIS_SQL = f"SELECT doc_id, upper(holder) AS v_name, dob AS v_dob, num AS v_number FROM ({I.ID_TEXT_SQL}) v"


@query("join_mrz_visible", f"""
SELECT p.doc_id, contains({letters('v_name')}, {letters('surname')}) AS surname_seen,
  CASE WHEN {date_sql('v_dob')} IS NULL THEN 'NOT_ASSESSED' WHEN strftime({date_sql('v_dob')}, '%y%m%d') = dob THEN 'PASS' ELSE 'FAIL' END AS dob_cmp,
  CASE WHEN contains({alnum('v_number')}, {alnum('document_number')}) OR contains({alnum('document_number')}, {alnum('v_number')}) THEN 'PASS' ELSE 'FAIL' END AS number_cmp
FROM ({PARSED}) p JOIN ({_VIS_SQL}) v ON v.doc_id = p.doc_id""")
def q_join_visible(spark, sf):
    vis = I.id_text(spark, sf).select("doc_id", F.upper("holder").alias("vis_name"),
                                      F.col("dob").alias("vis_dob"), F.col("num").alias("vis_number"))
    zone = om.parse(I.mrz_text(spark, sf).drop("vis_name", "vis_dob", "vis_number")).filter("parsed IS NOT NULL")
    c = om.compare(zone.join(vis, "doc_id"))
    return c.select("doc_id", F.contains(m.letters(F.col("vis_name")), m.letters(F.col("parsed.surname"))).alias("surname_seen"),
                    "dob_cmp", "number_cmp")


_ANA = f"""
SELECT d.doc_id, d.supports_mrz, CASE WHEN NOT d.supports_mrz THEN 'NOT_APPLICABLE' WHEN d.s.o = 'none' THEN 'NOT_DETECTED' WHEN d.s.o = 'partial' THEN 'PARTIAL' ELSE 'PARSED' END AS st,
 CASE WHEN d.s.o = 'partial' THEN 'FAIL' WHEN c.doc_id IS NULL THEN 'NOT_ASSESSED' ELSE 'PASS' END AS c1,
 CASE WHEN c.doc_id IS NULL THEN 'NOT_ASSESSED' WHEN number_ok AND dob_ok AND expiry_ok AND coalesce(optional_ok, true) AND composite_ok THEN 'PASS' ELSE 'FAIL' END AS c2,
 coalesce(name_cmp, 'NOT_ASSESSED') AS c3, coalesce(dob_cmp, 'NOT_ASSESSED') AS c4, coalesce(number_cmp, 'NOT_ASSESSED') AS c5,
 surname, given_names, document_number, dob, expiry, c.s.f AS fmt
FROM ({SEL_SQL}) d LEFT JOIN ({CMP_SQL}) c ON c.doc_id = d.doc_id"""


@query("mrz_checklist", f"""
SELECT doc_id, u.i AS item, u.s AS status FROM (SELECT doc_id, unnest(CASE WHEN supports_mrz THEN [
 {{'i': 'format_valid', 's': c1}}, {{'i': 'check_digits_valid', 's': c2}}, {{'i': 'name_consistency', 's': c3}},
 {{'i': 'dob_consistency', 's': c4}}, {{'i': 'document_number_consistency', 's': c5}}] ELSE [{{'i': 'mrz_applicable', 's': 'NOT_APPLICABLE'}}] END) AS u FROM ({_ANA}) a) b""")
def q_checklist(spark, sf):
    return om.analyze(I.mrz_text(spark, sf)).select("doc_id", F.inline("checklist")).drop("label")


@query("mrz_mask", f"""
SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(surname, '\\s+'), lambda w: CASE WHEN length(w) <= 1 THEN repeat('X', length(w)) ELSE left(w, 1) || repeat('X', length(w) - 1) END), ' ') AS surname,
 CASE WHEN length(document_number) <= 4 THEN repeat('X', length(document_number)) ELSE repeat('X', length(document_number) - 4) || right(document_number, 4) END AS document_number,
 regexp_replace(dob, '\\d', 'X', 'g') AS dob, regexp_replace(expiry, '\\d', 'X', 'g') AS expiry FROM ({PARSED}) p""")
def q_mask(spark, sf):
    return om.masked(om.parse(I.mrz_text(spark, sf))).filter("parsed IS NOT NULL").select(
        "doc_id", "mrz_fields.surname", "mrz_fields.document_number", "mrz_fields.dob", "mrz_fields.expiry")


@query("mrz_analyze", f"""SELECT doc_id, st AS mrz_status, CASE WHEN supports_mrz THEN coalesce(fmt, '') ELSE '' END AS structure, CASE WHEN supports_mrz THEN c2 ELSE 'NOT_ASSESSED' END AS digits,
 CASE WHEN supports_mrz THEN c3 ELSE 'NOT_ASSESSED' END AS name_cmp, CASE WHEN supports_mrz THEN c4 ELSE 'NOT_ASSESSED' END AS dob_cmp, CASE WHEN supports_mrz THEN c5 ELSE 'NOT_ASSESSED' END AS number_cmp FROM ({_ANA}) a""")
def q_analyze(spark, sf):
    return om.analyze(I.mrz_text(spark, sf)).select(
        "doc_id", "mrz_status", F.coalesce("structure", F.lit("")).alias("structure"),
        m.tri(F.col("check_digits_ok")).alias("digits"), "name_cmp", "dob_cmp", "number_cmp")


@query("agg_mrz_pass_rate", f"""
SELECT doc_id, round(CASE WHEN st <> 'PARSED' OR n = 0 THEN 0.0 ELSE np / n END, 4) AS rate, CAST(CASE WHEN st = 'PARSED' THEN 1 ELSE 0 END AS DOUBLE) AS parsed
FROM (SELECT doc_id, st, len(list_filter([c1, c2, c3, c4, c5], lambda x: x IN ('PASS', 'FAIL'))) AS n, len(list_filter([c1, c2, c3, c4, c5], lambda x: x = 'PASS')) AS np FROM ({_ANA}) a) b""")
def q_pass_rate(spark, sf):
    a = om.analyze(I.mrz_text(spark, sf)).withColumn(
        "p", om.pass_rate(F.col("checklist"), F.col("mrz_status"), F.col("check_digits_ok")))
    return a.select("doc_id", F.round("p.rate", 4).alias("rate"), "p.parsed")


# The zone printed as boxes: one box per text line, lower lines further down the page.
_REGION = f"""
SELECT doc_id, 0 AS block_num, line_num, line_num AS box_ord, 5 AS x, CAST(700 + 40 * line_num AS INT) AS y, line AS text FROM
 ({{explode}}) e"""
_REGION_SPARK = _REGION.format(explode=f"SELECT doc_id, CAST(line_num AS INT) AS line_num, line FROM ({I.MRZ_TEXT}) t LATERAL VIEW posexplode(split(full_text, '\\n')) l AS line_num, line")


@query("mrz_from_region_text", f"SELECT doc_id, CASE WHEN st = 'PARSED' THEN 'DETECTED' ELSE st END AS mrz_status, CASE WHEN supports_mrz THEN coalesce(fmt, '') ELSE '' END AS structure FROM ({_ANA}) a")
def q_region(spark, sf):
    docs = I.mrz_text(spark, sf).withColumn("page_h", F.lit(1000))
    return om.from_region(I.derive(spark, sf, _REGION_SPARK), docs).select(
        "doc_id", "mrz_status", F.coalesce("structure", F.lit("")).alias("structure"))
