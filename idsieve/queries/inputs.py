"""Stand-in inputs derived from the given tables.

The given tables hold no identity documents, so each query derives its input
(labelled text, boxes, MRZ lines, measurements) from them. The derivation is
plain SQL in a form that both engines read, so that a query and its check start
from the same rows. Every derivation covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.functions.common import fence

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Narrow tables whose rows are worked on at length: one row group of them can hold hours of work.
NARROW = ("customer", "supplier", "part", "orders", "events")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores. A scan gives one task to a row group, which may be the whole table.

    The fences keep filters on what is computed from these rows above the exchange.
    """
    dealt = rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.select(*[fence(F.col(c)).alias(c) for c in rows.columns])


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in sql}
    used = {t: spread(d) if t in NARROW else d for t, d in used.items()}
    return spark.sql(sql, **used)


def derive_from(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def plain(sql: str) -> str:
    """The same text for an engine that knows the tables by name."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def _pick(words: str, index: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', CAST({index} % {n} AS INT) + 1)"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


# One labelled document per customer, over all nine types, with missing labels,
# impossible dates, two-digit years and reversed dates mixed in.
ID_TEXT = f"""
SELECT k AS doc_id, document_type, holder, dob, issued, expires, num,
  CASE document_type
   WHEN 'PASSPORT' THEN 'Surname: ' || family || nl || 'Given Names: ' || given || nl
     || CASE WHEN k % 5 = 0 THEN '' ELSE 'Passport No: ' END || num || nl
     || 'Nationality: Utopia' || nl || 'Sex: ' || sex || nl
     || 'Date of Birth: ' || dob || nl || 'Date of Issue: ' || issued || nl
     || 'Date of Expiry: ' || expires
   WHEN 'VISA' THEN 'Name: ' || holder || nl || CASE WHEN k % 4 = 0 THEN '' ELSE 'Visa No: ' END
     || num || nl || 'Visa Type: Tourist' || nl || 'Nationality: Utopia' || nl
     || 'Date of Birth: ' || dob || nl || 'Date of Issue: ' || issued || nl
     || 'Valid until: ' || expires || nl || 'Entries: Multiple' || nl
     || 'Duration of stay: ' || CAST(10 + k % 80 AS STRING) || ' days'
   WHEN 'NATIONAL_ID' THEN 'Full Name: ' || holder || nl || dob || nl || 'Gender: ' || sex
     || nl || num || nl || 'Address: ' || CAST(k % 300 AS STRING) || ' Long Street, Old Town'
   WHEN 'DRIVING_LICENCE' THEN 'Driving Licence ' || num || nl || 'Name: ' || holder || nl
     || 'DOB: ' || dob || nl || 'DOI: ' || issued || nl || 'Valid till: ' || expires || nl
     || 'Address: ' || CAST(k % 300 AS STRING) || ' Hill Road'
   WHEN 'PERMIT' THEN 'Name: ' || holder || nl || 'Permit Type: Work' || nl || num || nl
     || 'Issued: ' || issued || nl || 'Expires on ' || expires || nl || 'Country: the'
   WHEN 'PAN' THEN 'Name: ' || holder || ' DOB: ' || dob || nl || 'Father Name: Abel '
     || family || nl || CASE WHEN k % 2 = 0 THEN 'PAN: ' ELSE '' END || num
   WHEN 'AADHAAR' THEN 'Name: ' || holder || nl || 'DOB: ' || dob || nl || 'Gender: ' || sex
     || nl || num || nl || 'Address: ' || CAST(k % 300 AS STRING) || ' River Lane, New Town'
   WHEN 'OTHER' THEN 'Holder''s name: ' || holder || nl || num || nl || 'born ' || dob
   ELSE 'illegible scan ' || CAST(k AS STRING) END AS full_text
FROM (
 SELECT *, given || ' ' || family AS holder,
  CASE WHEN k % 13 = 0 THEN '31/02/1990'
       WHEN k % 17 = 0 THEN {_pad('1 + k % 28', 2)} || '.' || {_pad('1 + k % 12', 2)} || '.' || {_pad('k % 100', 2)}
       WHEN k % 19 = 0 THEN {_pad('1 + k % 28', 2)} || ' Mar ' || CAST(1950 + k % 55 AS STRING)
       ELSE {_pad('1 + k % 28', 2)} || '/' || {_pad('1 + k % 12', 2)} || '/' || CAST(1950 + k % 55 AS STRING) END AS dob,
  {_pad('1 + k * 3 % 28', 2)} || '-' || {_pad('1 + k * 5 % 12', 2)} || '-'
    || CAST(CASE WHEN k % 29 = 0 THEN 1940 ELSE 2008 + k % 15 END AS STRING) AS issued,
  {_pad('1 + k * 3 % 28', 2)} || '/' || {_pad('1 + k * 5 % 12', 2)} || '/'
    || CAST(CASE WHEN k % 31 = 0 THEN 1999 ELSE 2018 + k % 15 END AS STRING) AS expires,
  CASE document_type
   WHEN 'PASSPORT' THEN chr(CAST(65 + k % 26 AS INT)) || {_pad('k * 7919 % 10000000', 7)}
   WHEN 'VISA' THEN 'V' || {_pad('k * 31 % 100000000', 8)}
   WHEN 'DRIVING_LICENCE' THEN 'MH-' || {_pad('k % 100', 2)} || '-' || CAST(1990 + k % 30 AS STRING) || '-' || {_pad('k % 10000000', 7)}
   WHEN 'PERMIT' THEN 'WP' || {_pad('k * 37 % 10000000', 7)}
   WHEN 'PAN' THEN chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + k * 3 % 26 AS INT)) || 'BPK'
        || {_pad('k % 10000', 4)} || chr(CAST(65 + k * 11 % 26 AS INT))
   ELSE {_pad('k * 13 % 10000', 4)} || ' ' || {_pad('k * 17 % 10000', 4)} || ' ' || {_pad('k * 19 % 10000', 4)} END AS num
 FROM (
  SELECT c_custkey AS k, chr(10) AS nl,
   {_pick('PASSPORT,VISA,NATIONAL_ID,DRIVING_LICENCE,PERMIT,PAN,AADHAAR,OTHER,UNKNOWN', 'c_custkey')} AS document_type,
   {_pick('Anna,Rahul,Maria,John,Erik,Priya,Omar', 'c_custkey')} AS given,
   {_pick('Sharma,Lopez,Eriksson,Khan,Smith', 'c_custkey')} AS family,
   {_pick('M,F,Male,Female,Other', 'c_custkey')} AS sex
  FROM {{customer}}) c1) c2
"""

# One (field, value) row per customer and field kind.
FIELD_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, '{field}' AS field, {value} AS value FROM ({ID_TEXT}) t"
    for field, value in (
        ("document_number", "num"), ("name", "holder"), ("date_of_birth", "dob"),
        ("address", "CASE WHEN doc_id % 3 = 0 THEN ' short ' ELSE '  12 Long Street, ' || holder END"),
        ("mrz_line1", "'p<uto' || holder"), ("nationality", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Utopia' END"),
        ("visa_number", "right(num, CAST(doc_id % 7 AS INT))"), ("Father_Name", "'J ' || holder"),
    )
)

# MRZ lines per customer: TD3, TD2 and TD1 in turn, some digits corrupted, some
# documents with one line or none.
MRZ_TEXT = f"""
SELECT k AS doc_id, document_type, supports_mrz, vis_name, vis_dob, vis_number,
  CASE WHEN k % 11 = 0 THEN 'plain prose without any zone'
       WHEN k % 10 = 0 THEN 'page' || nl || td3a
       WHEN k % 3 = 0 THEN 'Republic' || nl || td3a || nl || td3b
       WHEN k % 3 = 1 THEN td2a || nl || td2b || nl || 'end of page'
       ELSE td1a || nl || td1b || nl || td1c END AS full_text
FROM (
 SELECT *,
  rpad('P<UTO' || family || '<<' || given || '<', 44, '<') AS td3a,
  num || ncd || 'UTO' || dob6 || '2F' || exp6 || '9' || rpad('ZE' || CAST(k AS STRING), 14, '<') || '<' || CAST(k % 10 AS STRING) AS td3b,
  rpad('I<UTO' || family || '<<' || given || '<', 36, '<') AS td2a,
  num || ncd || 'UTO' || dob6 || '2M' || exp6 || '9' || '<<<<<<<' || CAST(k % 10 AS STRING) AS td2b,
  rpad('I<UTO' || num || ncd, 30, '<') AS td1a,
  dob6 || '2F' || exp6 || '9UTO' || '<<<<<<<<<<<' || CAST(k % 10 AS STRING) AS td1b,
  rpad(family || '<<' || given, 30, '<') AS td1c
 FROM (
  SELECT c_custkey AS k, chr(10) AS nl,
   {_pick('PASSPORT,VISA,NATIONAL_ID,PAN', 'c_custkey')} AS document_type,
   c_custkey % 4 <> 3 AS supports_mrz,
   {_pick('ERIKSSON,LOPEZ,KHAN,NOVAK,SMITH', 'c_custkey')} AS family,
   {_pick('ANNA<MARIA,JOHN,OMAR,PRIYA', 'c_custkey')} AS given,
   rpad(chr(CAST(65 + c_custkey % 26 AS INT)) || {_pad('c_custkey * 7919 % 1000000', 6)}, 9, '<') AS num,
   CAST(c_custkey % 10 AS STRING) AS ncd,
   {_pad('(50 + c_custkey) % 100', 2)} || {_pad('1 + c_custkey % 12', 2)} || {_pad('1 + c_custkey % 28', 2)} AS dob6,
   '30' || {_pad('1 + c_custkey % 12', 2)} || '15' AS exp6,
   CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Anna Maria Eriksson' WHEN 2 THEN 'John Lopez'
     WHEN 3 THEN 'Omar Zulu Quebec' WHEN 4 THEN 'Smith, Priya' ELSE 'Nobody Else' END AS vis_name,
   CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '01/01/1901'
     ELSE {_pad('1 + c_custkey % 28', 2)} || '/' || {_pad('1 + c_custkey % 12', 2)} || '/' || CAST(1950 + c_custkey % 50 AS STRING) END AS vis_dob,
   CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'ZZ000'
     ELSE chr(CAST(65 + c_custkey % 26 AS INT)) || ' ' || {_pad('c_custkey * 7919 % 1000000', 6)} END AS vis_number
  FROM {{customer}}) m1) m2
"""

# OCR boxes: one per word of the labelled text, as three passes that each miss
# some words. Splitting into rows differs between the engines.
_BOX_COLUMNS = """
  doc_id, document_type, pass_name AS pass, CAST(pass_ord AS INT) AS pass_ord,
  CAST(line_num / 4 - line_num / 4 % 1 AS INT) AS block_num, CAST(line_num AS INT) AS line_num,
  CAST(line_num * 100 + word_num AS INT) AS box_ord,
  CAST(40 * ((word_num * 3) % 7) AS INT) AS x, CAST(30 * line_num AS INT) AS y,
  CAST(10 * length(word) AS INT) AS w, CAST(20 + (doc_id * 7 + word_num) % 9 AS INT) AS h,
  word AS text,
  CAST((doc_id * 31 + line_num * 7 + word_num * 13 + pass_ord * 17) % 97 AS DOUBLE) / 97.0 AS confidence
"""

ID_BOXES_SPARK = f"""
SELECT {_BOX_COLUMNS} FROM (
 SELECT doc_id, document_type, pass_ord, pass_name, line_num, word_num, word
 FROM {{texts}} t
 LATERAL VIEW posexplode(split(full_text, '\\n')) l AS line_num, line
 LATERAL VIEW posexplode(split(line, ' ')) v AS word_num, word
 LATERAL VIEW posexplode(array('contrast', 'binary', 'gray')) p AS pass_ord, pass_name) b
WHERE (doc_id + line_num * 3 + word_num + pass_ord * 5) % 7 <> 0
"""

ID_BOXES_DUCK = f"""
SELECT {_BOX_COLUMNS} FROM (
 SELECT doc_id, document_type, pass_ord, ['contrast', 'binary', 'gray'][pass_ord + 1] AS pass_name,
  line_num, unnest(range(len(words))) AS word_num, unnest(words) AS word
 FROM (
  SELECT doc_id, document_type, pass_ord, line_num, string_split(line, ' ') AS words FROM (
   SELECT doc_id, document_type, pass_ord, unnest(range(len(lines))) AS line_num, unnest(lines) AS line
   FROM (SELECT doc_id, document_type, string_split(full_text, chr(10)) AS lines, unnest([0, 1, 2]) AS pass_ord
         FROM ({ID_TEXT}) t) l0) l1) l2) b
WHERE (doc_id + line_num * 3 + word_num + pass_ord * 5) % 7 <> 0
"""


def id_text(spark: SparkSession, sf: str) -> DataFrame:
    return _fenced(derive(spark, sf, ID_TEXT))


def id_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return derive_from(spark, ID_BOXES_SPARK, texts=id_text(spark, sf))


def mrz_text(spark: SparkSession, sf: str) -> DataFrame:
    return _fenced(derive(spark, sf, MRZ_TEXT))


def _fenced(texts: DataFrame) -> DataFrame:
    """The text is put together once, not again in every filter on what is read from it."""
    return texts.withColumn("full_text", fence(F.col("full_text")))


def at(spark: SparkSession, day: str):
    """A fixed date literal standing for today."""
    return F.lit(day).cast("date")


TODAY = "2026-01-15"

ID_TEXT_SQL = plain(ID_TEXT)
FIELD_VALUES_SQL = plain(FIELD_VALUES)
MRZ_TEXT_SQL = plain(MRZ_TEXT)
ID_BOXES_SQL = plain(ID_BOXES_DUCK)
