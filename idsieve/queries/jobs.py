"""Sources, sinks and whole jobs over the given tables."""

from pyspark.sql import functions as F

from idsieve.operators import decision as od, evidence as oe
from idsieve.plans import jobs
from idsieve.plans.folders import work_folder
from idsieve.queries import cases as qc, images as qi, inputs as I, intake as qn, text as qt, vectors as qv
from idsieve.queries.registry import query
from idsieve.settings import Settings
from idsieve.sources import files as sfiles
from idsieve.streaming.screen import CASES, EVENTS, read_sink, screen_stream, screen_to_sinks


@query("src_files")
def q_files(spark, sf):
    d = sfiles.read_heads(spark, sf, "*.parquet", 4)
    return d.select("filename", "size_bytes", F.hex("head").alias("head"))


_BYTE = "CAST(greatest(0, least(255, floor(128 + 300 * CAST({0} AS DOUBLE)))) AS INT)"


@query("src_image_cells", f"SELECT vec_id::VARCHAR AS path, CAST(pos // 8 AS INT) AS r, CAST(pos % 8 AS INT) AS c, CAST({_BYTE.format('v')} AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) e")
def q_cells(spark, sf):
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(
        F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * v.cast("double")))).cast("int")), 2, "0")), ""))
    images = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("channels"), data.alias("data"))
    return sfiles.gray_cells(images, band=3).select("path", "r", "c", "value")


@query("sink_store_upload", f"SELECT left(sha256(path), 32) || ext AS name, sha256(unhex(content_hex)) AS content_sha FROM ({qn.V1}) v WHERE {qn.CODE} IS NULL")
def q_store(spark, sf):
    """Accepted bytes written to the store by day, and read back; where uploads are not retained nothing is written."""
    path = work_folder(spark, "uploads")
    files = qn.coded(spark, sf).withColumn("modified", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600))
    if sfiles.store_uploads(files, path, Settings()) is not None:
        raise AssertionError("uploads are kept only where the settings say so")
    sfiles.store_uploads(files, path, Settings(retain_uploads=True))
    return spark.read.parquet(path).select("name", F.sha2("content", 256).alias("content_sha"))


_TEXT = f"""SELECT d.doc_id, d.document_type, coalesce(x.full_text, '') AS full_text FROM ({I.ID_TEXT_SQL}) d LEFT JOIN (
 SELECT doc_id, string_agg(line_text, chr(10) ORDER BY block_num, line_num) AS full_text FROM ({qt.LINES_SQL.format(qt.BOXES_SQL)}) l GROUP BY doc_id) x ON x.doc_id = d.doc_id"""
_FOUND = qt.EXTRACT_SQL.replace(f"({I.ID_TEXT_SQL}) t0", f"({_TEXT}) t0")


@query("job_text", f"SELECT d.doc_id, coalesce(f.n, 0) AS field_count, coalesce(f.fields, '') AS fields FROM ({_TEXT}) d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(field, ',' ORDER BY field) AS fields FROM ({_FOUND}) g GROUP BY doc_id) f ON f.doc_id = d.doc_id")
def q_text(spark, sf):
    docs = I.id_text(spark, sf).select("doc_id", "document_type")
    _, fields, summary = jobs.text_job(docs, I.id_boxes(spark, sf), I.at(spark, I.TODAY))
    names = fields.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    return summary.join(names, "doc_id", "left").select("doc_id", "field_count", F.coalesce("fields", F.lit("")).alias("fields"))


def screen_modules(spark, sf):
    """All modules of the documents, by name: each keyed by doc_id, from the table that stands for its input."""
    quality = jobs.quality_job(qi.measures(spark, sf)).select(
        "doc_id", "overall_quality", F.col("overall_quality").alias("evidence_quality"),
        "insufficient_for_analysis", "reason")
    types = jobs.classify_job(qv.cues(spark, sf), qv.CW, qv.CB).select("doc_id", "document_type", "type_confidence")
    tamper = jobs.image_job(qi.images(spark, sf), qi.SMALL).select("doc_id", "severity", "review_score", "tamper_status")
    drop = ["vec_id", "label", "evidence_quality", "ocr_confidence", "field_completeness", "doc_type_confidence",
            "mrz_check_pass_rate", "mrz_parsed"]
    vision = qv.fusion_inputs(spark, sf).drop(*drop).withColumns({
        "enet_ok": F.col("enet_present") > 0, "vit_ok": F.col("vit_present") > 0, "clip_ok": F.col("clip_present") > 0})
    text = jobs.text_module(I.id_text(spark, sf).select("doc_id", "document_type"), I.id_boxes(spark, sf), I.at(spark, I.TODAY))
    frames = I.derive(spark, sf, qc.PAD).withColumns({"channel_means": F.array("m1", "m2", "m3"), "doc_id": F.col("event_id") % 1000})
    return {"quality": quality, "types": types, "tamper": tamper, "vision": vision, "text": text,
            "faces": jobs.face_module(qc.compared(spark, sf)), "liveness": jobs.liveness_module(frames, "doc_id")}


def screened(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.lit(1.0).alias("one"))
    return jobs.screen_job(docs, list(screen_modules(spark, sf).values()), qv.FW, qv.FB, (1.3, 0.2))


@query("job_screen")
def q_screen(spark, sf):
    """All modules of the documents, through checks and fusion to the decision."""
    return screened(spark, sf).select(
        "doc_id", "document_type", "ocr_status", "fields_status", "mrz_status", "pad_decision", "fusion_status", "calibration_status", "cv_overall", "confidence",
        "doc_status", "id_status", "decision", F.size("reasons").alias("n_reasons"))


def _screen_documents(batch):
    d = batch.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(2000.0)).alias("evidence_quality"))
    d = d.withColumns({"overall_quality": F.col("evidence_quality"), "ocr_status": F.lit("OK"),
                       "severity": F.lit("LOW_SIGNAL"), "tamper_status": F.lit("ANALYZED")})
    d = od.decide(oe.confidence(oe.prior_decision(oe.rollup_in_row(oe.checks_column(d)))))
    return d.select("doc_id", "doc_status", "decision", "confidence")


@query("st_screen", """SELECT doc_id, CASE WHEN q >= 0.5 AND c >= 0.45 THEN 'AUTHENTIC' ELSE 'INCONCLUSIVE' END AS doc_status, 'INCONCLUSIVE' AS decision FROM (
 SELECT doc_id, q, round(0.28 * q + 0.14 * 0.35 + 0.1 * 0.35 + 0.1 * 0.45 + 0.08 * round(CASE WHEN q < 0.45 THEN 2 / 3 ELSE 1.0 END + 1e-9, 4) + 0.04 * 0.35 + 1e-9, 4) AS c FROM (SELECT doc_id, least(1.0, n_chars / 2000.0) AS q FROM documents) a) b""")
def q_stream(spark, sf):
    """The documents as a stream of files, screened batch by batch into a case folder."""
    schema = I.table(spark, sf, "documents").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    folder = work_folder(spark, "st_screen")
    screen_stream(source, _screen_documents, f"{folder}/cases", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/cases").select("doc_id", "doc_status", "decision")


def _cases_of(batch):
    """Documents as case rows: decided by the whole chain of checks, typed by their language."""
    return _screen_documents(batch.drop("submitted_at")).join(batch.select("doc_id", F.upper(F.coalesce("lang", F.lit("unknown"))).alias("document_type")), "doc_id")


_CASE_SQL = """SELECT doc_id, printf('DS-2024-%06d', row_number() OVER (ORDER BY doc_id)) AS case_id, upper(coalesce(lang, 'unknown')) AS document_type FROM documents"""


@query("st_screen_sinks", f"""SELECT doc_id, case_id, document_type, decision, sha256(repeat('0', 64) || '|' || '{{"action":"ANALYZE","actor":"system","case_id":"' || case_id || '","summary":"decision=' || decision || ' type=' || document_type || '"}}') AS entry_hash
FROM (SELECT *, 'INCONCLUSIVE' AS decision FROM ({_CASE_SQL}) c) d""")
def q_sinks(spark, sf):
    """All documents as a stream in three batches, into cases, audit rows and tips, read back by the list of finished batches."""
    docs = I.table(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    docs = docs.withColumn("submitted_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 10_000_000))
    folder = work_folder(spark, "st_screen_sinks")
    for k in range(3):
        part = docs.filter(F.least(F.floor(F.col("doc_id") * 3 / (last + 1)), F.lit(2)) == k)
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        screen_to_sinks(source, _cases_of, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    cases = read_sink(spark, f"{folder}/out", "cases", CASES).drop("batch")
    events = read_sink(spark, f"{folder}/out", "audit", EVENTS).select("case_id", "entry_hash")
    return cases.join(events, "case_id").select("doc_id", "case_id", "document_type", "decision", "entry_hash")
