"""Upload validation and retention over pages and documents turned into bytes."""

from pyspark.sql import functions as F

from idsieve.operators import intake as oi
from idsieve.queries import inputs as I
from idsieve.queries.registry import query
from idsieve.settings import Settings

_FILE = """SELECT src || '-' || CAST(id AS STRING) AS path, id,
 CASE id % 9 WHEN 0 THEN '/in/box/' WHEN 1 THEN 'a b/' ELSE '' END || CASE id % 11 WHEN 0 THEN 'my:scan*' WHEN 1 THEN 'Скан ' ELSE 'scan_' END || CAST(id AS STRING)
  || CASE id % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' WHEN 5 THEN '.html' ELSE '' END AS filename,
 CASE CAST(floor(id / 7) AS BIGINT) % 10 WHEN 0 THEN '' ELSE
  CASE CAST(floor(id / 7) AS BIGINT) % 10 WHEN 1 THEN '4D5A9000' WHEN 2 THEN '0A20' WHEN 3 THEN 'FFD8FFE000104A46494600010100000100010000' || CASE WHEN id % 17 = 5 THEN 'FFD9' ELSE 'FFFFC2001108' || lpad(hex(100 + id * 53 % 7000), 4, '0') || lpad(hex(CASE WHEN id % 13 = 0 THEN 0 ELSE 100 + id * 37 % 9000 END), 4, '0') || '03012200021101031101' END WHEN 4 THEN '524946460000000057454250' WHEN 5 THEN '255044462D312E37'
   ELSE '89504E470D0A1A0A0000000D49484452' || lpad(hex(CASE WHEN id % 13 = 0 THEN 0 ELSE 100 + id * 37 % 9000 END), 8, '0') || lpad(hex(100 + id * 53 % 7000), 8, '0') END || hex(body) END AS content_hex
FROM (SELECT 'page' AS src, page_id AS id, html AS body FROM {pages} UNION ALL SELECT 'doc' AS src, doc_id AS id, text AS body FROM {documents}) b"""
FILES_SQL = I.plain(_FILE)
SET = Settings(max_upload_bytes=20_000)


def files(spark, sf):
    return I.derive(spark, sf, _FILE).withColumn("content", F.unhex("content_hex")).drop("content_hex")


_LEN = "(length(content_hex) // 2)"
_HEAD = "regexp_replace(left(content_hex, 128), '^(20|09|0A|0D|0B|0C)+', '')"
_DANGER = " OR ".join(f"starts_with({_HEAD}, '{p}')" for p in (
    "4D5A", "7F454C46", "3C21444F4354595045", "3C21646F6374797065", "3C68746D6C", "3C48544D4C", "3C3F706870", "23212F"))
# The last path part; then everything but word characters, dots, hyphens, blanks and brackets is folded.
_BASE = "regexp_extract(filename, '([^/]*)/*$', 1)"
_FULL = f"regexp_replace({_BASE}, '[^\\pL\\pM\\pN_.\\- ()\\[\\]]+', '_', 'g')"
_SAFE = f"left({_FULL}, 200)"
_KIND = f"""CASE WHEN {_LEN} < 12 THEN NULL WHEN starts_with(content_hex, '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(content_hex, 'FFD8FF') THEN 'JPEG'
 WHEN starts_with(content_hex, '52494646') AND substr(content_hex, 17, 8) = '57454250' THEN 'WEBP' WHEN starts_with(content_hex, '25504446') THEN 'PDF' END"""
_EXT = "lower(regexp_extract(safe, '^.+(\\.[^.]+)$', 1))"


def _num(at):
    return f"CAST('0x' || substr(content_hex, {at}, 8) AS BIGINT)"


V0 = f"SELECT *, {_SAFE} AS safe, {_KIND} AS kind FROM ({FILES_SQL}) f"
# The JPEG bytes made here have one segment, then a fill byte and the frame header or the end.
_FRAME = "kind = 'JPEG' AND substr(content_hex, 41, 6) = 'FFFFC2'"


def _half(at):
    return f"CAST('0x' || substr(content_hex, {at}, 4) AS BIGINT)"


V1 = f"""SELECT *, {_EXT} AS ext, CASE WHEN kind = 'PNG' THEN {_num(33)} WHEN {_FRAME} THEN {_half(57)} END AS w, CASE WHEN kind = 'PNG' THEN {_num(41)} WHEN {_FRAME} THEN {_half(53)} END AS h FROM ({V0}) v0"""
_HEADER = f"""CASE WHEN {_LEN} = 0 THEN 'EMPTY_FILE' WHEN {_LEN} > 20000 THEN 'FILE_TOO_LARGE' WHEN {_DANGER} THEN 'DANGEROUS_CONTENT'
 WHEN ext NOT IN ('.png', '.jpg', '.jpeg', '.webp'{{pdf}}) THEN 'BAD_EXTENSION' WHEN kind IS NULL THEN 'BAD_SIGNATURE'
 WHEN NOT ((kind = 'JPEG' AND ext IN ('.jpg', '.jpeg')) OR (kind = 'PNG' AND ext = '.png') OR (kind = 'WEBP' AND ext = '.webp') OR (kind = 'PDF' AND ext = '.pdf')) THEN 'MIME_MISMATCH'
 WHEN kind = 'WEBP' AND substr(content_hex, 25, 8) NOT IN ('56503820', '5650384C', '56503858') THEN 'CORRUPT_IMAGE' WHEN kind = 'JPEG' AND w IS NULL THEN 'CORRUPT_IMAGE'
 {{off}} WHEN w * h <= 0 THEN 'BAD_DIMENSIONS' WHEN w * h > 40000000 THEN 'TOO_MANY_PIXELS' END"""
CODE = _HEADER.format(pdf=", '.pdf'", off="")
CODE_NO_PDF = _HEADER.format(pdf="", off="WHEN kind = 'PDF' THEN 'PDF_DISABLED'")


def coded(spark, sf, settings=SET):
    return oi.validate(files(spark, sf), settings)


# One query per rule: the files it rejects, by path.
for _name, _code in (("val_empty", "EMPTY_FILE"), ("val_size", "FILE_TOO_LARGE"), ("val_danger", "DANGEROUS_CONTENT"),
                     ("val_ext", "BAD_EXTENSION"), ("val_mismatch", "MIME_MISMATCH")):
    query(_name, f"SELECT path, code FROM (SELECT path, {CODE} AS code FROM ({V1}) v) z WHERE code = '{_code}'")(
        lambda s, sf, c=_code: coded(s, sf).filter(F.col("code") == c).select("path", "code"))

query("val_filename", f"SELECT path, safe AS safe_name, {_FULL} AS full_name FROM ({V0}) v")(
    lambda s, sf: files(s, sf).select("path", oi.safe_filename(F.col("filename")).alias("safe_name"), oi.clean_filename(F.col("filename")).alias("full_name")))
query("val_sniff", f"SELECT path, coalesce(kind, 'BAD_SIGNATURE') AS kind FROM ({V0}) v")(
    lambda s, sf: files(s, sf).select("path", F.coalesce(oi.sniff(F.col("content")), F.lit("BAD_SIGNATURE")).alias("kind")))
query("val_pdf", f"SELECT path, coalesce({CODE_NO_PDF}, 'ok') AS code FROM ({V1}) v WHERE kind = 'PDF'")(
    lambda s, sf: coded(s, sf, Settings(max_upload_bytes=20_000, allow_pdf=False)).filter("sniffed = 'PDF'").select(
        "path", F.coalesce("code", F.lit("ok")).alias("code")))
query("val_dims", f"SELECT path, w AS width, h AS height, CASE WHEN w * h <= 0 THEN 'BAD_DIMENSIONS' WHEN w * h > 40000000 THEN 'TOO_MANY_PIXELS' ELSE 'ok' END AS size_code FROM ({V1}) v WHERE kind IN ('PNG', 'JPEG') AND w IS NOT NULL")(
    lambda s, sf: coded(s, sf).filter("sniffed IN ('PNG', 'JPEG') AND width IS NOT NULL").select("path", "width", "height", F.expr(
        "CASE WHEN width * height <= 0 THEN 'BAD_DIMENSIONS' WHEN width * height > 40000000 THEN 'TOO_MANY_PIXELS' ELSE 'ok' END").alias("size_code")))

_MIME = "CASE ext WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.webp' THEN 'image/webp' ELSE 'application/pdf' END"


@query("intake_meta", f"SELECT path, safe AS filename, {_MIME} AS mime_type, {_LEN} AS size_bytes, CASE WHEN kind = 'PDF' THEN 'PDF' ELSE 'IMAGE' END AS source_format, 'ACCEPTED' AS status FROM ({V1}) v WHERE {CODE} IS NULL")
def q_meta(spark, sf):
    return oi.accepted_metadata(coded(spark, sf), SET).select(
        "path", "filename", "mime_type", "size_bytes", "source_format", "status")


@query("job_intake", f"SELECT coalesce(code, 'ACCEPTED') AS outcome, count(*) AS n, sum(len) AS bytes FROM (SELECT {CODE} AS code, {_LEN} AS len FROM ({V1}) v) z GROUP BY 1")
def job_intake(spark, sf):
    return coded(spark, sf).groupBy(F.coalesce("code", F.lit("ACCEPTED")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("bytes"))


_NOW = "TIMESTAMP '2024-01-16 00:00:00'"


@query("retention_purge", f"SELECT event_id, event_type AS name FROM events WHERE epoch_us({_NOW}) - epoch_us(ts) > 3600000000 AND event_type <> 'error'")
def q_purge(spark, sf):
    up = I.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("modified"),
        F.when(F.col("event_type") == "error", F.lit(".hidden")).otherwise(F.col("event_type")).alias("name"))
    return oi.retention_split(up, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), 3600)[1].select("event_id", "name")
