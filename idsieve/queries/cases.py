"""Faces, sessions, cases, reports, audit chains and rate limits over events, orders, embeddings."""

from pyspark.sql import functions as F

from idsieve.operators import audit as oa, cases as oc, hash_tree as ht, identity as oi
from idsieve.plans import jobs
from idsieve.plans.folders import stored, work_folder
from idsieve.queries import inputs as I
from idsieve.queries.registry import query
from idsieve.streaming import rate_limit as rl, sessions as ss

# --- faces: embeddings as faces of sessions, two sides each -------------------------------

# Every vector is a face. Some stand in sessions of their own, so that sides are absent, single or many.
_FACE = """SELECT CASE WHEN (vec_id % 5 >= 2 AND floor(vec_id / 5) % 3 > 0) OR (vec_id % 5 = 1 AND floor(vec_id / 5) % 8 = 1) THEN 1000000000000 ELSE 0 END + CAST(floor(vec_id / 5) AS BIGINT) AS session_id,
 CASE WHEN vec_id % 5 IN (0, 3) THEN 'document' ELSE 'live' END AS role, vec_id AS face_ord, CAST(20 + vec_id * 7 % 90 AS INT) AS w, CAST(20 + vec_id * 11 % 90 AS INT) AS h,
 {vec} AS embedding, CASE WHEN vec_id % 35 IN (0, 1) THEN 'same' ELSE CAST(vec_id AS STRING) END AS image_sha, CAST(vec_id * 13 % 601 AS DOUBLE) AS laplacian_variance, CAST(vec_id * 17 % 256 AS DOUBLE) AS mean_gray, CAST(vec_id * 19 % 97 AS DOUBLE) AS std_gray, 640 AS img_w, 480 AS img_h
 FROM {src}"""
# Every fourth session shows nearly the same vector on both sides.
FACES_SPARK = _FACE.format(vec="CASE WHEN floor(vec_id / 5) % 4 = 0 THEN transform(CAST(embedding AS array<double>), (x, i) -> 0.1 + (i % 5) + x / 9) ELSE CAST(embedding AS array<double>) END", src="{embeddings}")
FACES_DUCK = _FACE.format(vec="CASE WHEN vec_id // 5 % 4 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: 0.1 + ((i - 1) % 5) + x / 9) ELSE CAST(embedding AS DOUBLE[]) END", src="embeddings")
QUAL = f"""SELECT *, CASE WHEN q >= 0.65 AND af >= 0.02 THEN 'GOOD' WHEN q >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS face_label FROM (
 SELECT *, 0.35 * least(laplacian_variance / 500, 1.0) + 0.25 * greatest(0.0, 1 - abs(mean_gray - 128) / 128) + 0.2 * least(std_gray / 64, 1.0) + 0.2 * least(af / 0.08, 1.0) AS q FROM (SELECT *, w * h / (640 * 480) AS af FROM ({FACES_DUCK}) f) g) k"""


def faces(spark, sf):
    return oi.face_quality(I.derive(spark, sf, FACES_SPARK))


query("face_quality", f"SELECT face_ord, round(q + 1e-9, 4) AS quality, face_label FROM ({QUAL}) q")(
    lambda s, sf: faces(s, sf).select("face_ord", F.round(F.col("face_quality") + 1e-9, 4).alias("quality"), "face_label"))

COUNT = f"SELECT r.session_id, r.role, coalesce(n, 0) AS face_count, CASE coalesce(n, 0) WHEN 0 THEN 'NOT_DETECTED' WHEN 1 THEN 'DETECTED' ELSE 'MULTIPLE_DETECTED' END AS face_status FROM (SELECT DISTINCT session_id, x.role FROM ({FACES_DUCK}) f0, (VALUES ('document'), ('live')) x(role)) r LEFT JOIN (SELECT session_id, role, count(*) AS n FROM ({FACES_DUCK}) f GROUP BY ALL) c ON c.session_id = r.session_id AND c.role = r.role"


def images(spark, sf):
    s = I.derive(spark, sf, FACES_SPARK).select("session_id").distinct()
    return s.withColumn("role", F.explode(F.array(F.lit("document"), F.lit("live"))))


query("agg_face_count", COUNT)(lambda s, sf: oi.face_counts(images(s, sf), faces(s, sf), ["session_id", "role"]))
PRIM = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY w * h DESC, face_ord) AS rn, count(*) OVER (PARTITION BY session_id, role) AS n FROM ({QUAL}) q) z WHERE rn = 1"
query("top_faces", f"SELECT session_id, role, face_ord, w, h FROM ({PRIM}) p")(
    lambda s, sf: oi.primary_faces(faces(s, sf), ["session_id", "role"]).select("session_id", "role", "primary.face_ord", "primary.w", "primary.h"))
_ID = "left(sha256(array_to_string(list_transform(embedding, lambda x: printf('%.6f', x)), ',')), 16)"
query("face_summary", f"SELECT session_id, role, n AS face_count, n = 1 AS detected, {_ID} AS embedding_id FROM ({PRIM}) p")(
    lambda s, sf: oi.face_summary(faces(s, sf), ["session_id", "role"]).select("session_id", "role", "face_count", "detected", "embedding_id"))
query("job_faces", f"SELECT c.session_id, c.role, c.face_status, coalesce(p.face_ord, -1) AS primary_face, 'NOT_AVAILABLE' AS ver_result FROM ({COUNT}) c LEFT JOIN ({PRIM}) p ON p.session_id = c.session_id AND p.role = c.role")(
    lambda s, sf: jobs.faces_job(images(s, sf), I.derive(s, sf, FACES_SPARK), ["session_id", "role"]).select(
        "session_id", "role", "face_status", F.coalesce("primary.face_ord", F.lit(-1)).alias("primary_face"), "ver_result"))
_DOT = "list_sum(list_transform(range(1, 65), lambda i: d.embedding[i] * l.embedding[i]))"
_NRM = "(sqrt(list_sum(list_transform({0}.embedding, lambda x: x * x))) + 1e-8)"
CMP = f"""SELECT *, CASE WHEN dn = 0 OR ln = 0 THEN 'NOT_AVAILABLE' WHEN dn > 1 OR ln > 1 THEN 'INCONCLUSIVE' WHEN same THEN 'INCONCLUSIVE' WHEN sim >= 0.96 AND poor THEN 'INCONCLUSIVE' WHEN sim >= 0.96 THEN 'MATCH' WHEN sim <= 0.7 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS cmp_result FROM (
 SELECT coalesce(d.session_id, l.session_id) AS session_id, coalesce(d.n, 0) AS dn, coalesce(l.n, 0) AS ln, d.image_sha = l.image_sha OR d.embedding = l.embedding AS same, d.face_label = 'POOR' OR l.face_label = 'POOR' AS poor,
  CASE WHEN d.n = 1 AND l.n = 1 THEN greatest(least(({_DOT} / ({_NRM.format('d')} * {_NRM.format('l')}) + 1) / 2, 1.0), 0.0) END AS sim
 FROM (SELECT * FROM ({PRIM}) p WHERE role = 'document') d FULL JOIN (SELECT * FROM ({PRIM}) p WHERE role = 'live') l ON l.session_id = d.session_id) c"""


def compared(spark, sf):
    f = faces(spark, sf)
    return oi.compare_faces(oi.pair_sides(f.filter("role = 'document'"), f.filter("role = 'live'")))


_CO = ["session_id", "cmp_result"]
query("join_doc_live_face", f"SELECT session_id, dn AS doc_count, ln AS live_count FROM ({CMP}) c")(lambda s, sf: compared(s, sf).select("session_id", "doc_count", "live_count"))
query("face_compare", f"SELECT session_id, cmp_result, coalesce(round(sim + 1e-9, 4), -1.0) AS similarity FROM ({CMP}) c")(
    lambda s, sf: compared(s, sf).select(*_CO, F.coalesce("similarity", F.lit(-1.0)).alias("similarity")))
query("job_face_compare", f"SELECT cmp_result, count(*) AS n FROM ({CMP}) c GROUP BY 1")(lambda s, sf: compared(s, sf).groupBy("cmp_result").agg(F.count(F.lit(1)).alias("n")))

# --- liveness -----------------------------------------------------------------------------------

PAD = """SELECT event_id, CASE user_id % 9 WHEN 0 THEN 'document' WHEN 1 THEN 'odd text' ELSE 'live_camera' END AS source, CAST(CASE WHEN event_id % 14 = 0 THEN 0 ELSE 1 END AS BIGINT) AS face_count, CAST(event_id * 7 % 307 AS DOUBLE) AS flat_lap,
 CAST(event_id * 11 % 101 AS DOUBLE) / 101.0 * CAST(event_id % 2 AS DOUBLE) AS moire, CAST(event_id * 13 % 103 AS DOUBLE) / 1500.0 AS specular_frac, CAST(event_id * 17 % 107 AS DOUBLE) / 1100.0 AS area_fraction,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 19 % 109 AS DOUBLE) / 1090.0 END AS motion, CAST(80 + event_id % 97 AS DOUBLE) AS m1, CAST(90 + event_id % 53 AS DOUBLE) AS m2, CAST(100 + event_id % 31 AS DOUBLE) AS m3 FROM {events}"""
PADS = f"""SELECT *, src = 'document' AS isdoc, face_count = 0 AS nof, 0.3 * flat + 0.25 * mo + 0.2 * spc + 0.1 * cst + 0.15 * stat + 0.1 * sz AS sp0,
 concat_ws(',', CASE WHEN flat >= 0.65 THEN 'flat_texture' END, CASE WHEN mo >= 0.55 THEN 'moire_like_energy' END, CASE WHEN spc >= 0.55 THEN 'specular_glare' END, CASE WHEN stat > 0 THEN 'low_frame_motion' END, CASE WHEN area_fraction < 0.02 THEN 'face_too_small' END) AS fl FROM (
 SELECT *, CASE WHEN source = 'document' THEN 'document' ELSE 'live_camera' END AS src, 1 - least(flat_lap / 250, 1.0) AS flat, moire AS mo, least(specular_frac / 0.08, 1.0) AS spc, least(list_stddev_pop([m1, m2, m3]) / (greatest(m1, m2, m3) + 1e-6) / 0.35, 1.0) AS cst,
  CASE WHEN motion < 0.02 THEN 0.35 ELSE 0.0 END AS stat, greatest(0.0, least(0.03 / greatest(area_fraction, 1e-6) - 1, 1.0)) AS sz FROM ({I.plain(PAD)}) p) p1"""
PADD = f"""SELECT *, CASE WHEN isdoc THEN 'NOT_APPLICABLE' WHEN nof THEN 'INCONCLUSIVE' WHEN sp >= 0.62 OR nfl >= 3 THEN 'SUSPECT_PRESENTATION_ATTACK' WHEN sp <= 0.35 AND nfl = 0 THEN 'PASSIVE_OK_UNCALIBRATED' ELSE 'INCONCLUSIVE' END AS pad_decision
FROM (SELECT *, least(sp0, 1.0) AS sp, CASE WHEN fl = '' THEN 0 ELSE length(fl) - length(replace(fl, ',', '')) + 1 END AS nfl FROM ({PADS}) s) t"""


def pads(spark, sf):
    d = I.derive(spark, sf, PAD).withColumn("channel_means", F.array("m1", "m2", "m3"))
    return oi.pad(d)


query("pad_score", f"SELECT event_id, CASE WHEN isdoc OR nof THEN -1.0 ELSE round(sp + 1e-9, 4) END AS pad_score FROM ({PADD}) p")(
    lambda s, sf: pads(s, sf).select("event_id", F.coalesce("pad_score", F.lit(-1.0)).alias("pad_score")))
query("pad_flags", f"SELECT event_id, fl AS flags FROM ({PADD}) p")(lambda s, sf: pads(s, sf).select("event_id", F.array_join("pad_flags", ",").alias("flags")))
query("pad_decision", f"SELECT event_id, pad_decision FROM ({PADD}) p")(lambda s, sf: pads(s, sf).select("event_id", "pad_decision"))
query("job_liveness", f"SELECT src AS source, pad_decision, count(*) AS n FROM ({PADD}) p GROUP BY ALL")(
    lambda s, sf: pads(s, sf).groupBy("source", "pad_decision").agg(F.count(F.lit(1)).alias("n")))

# --- sessions: users as sessions, opened by their first event ----------------------------------------

_US = "CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)) AS BIGINT)"
EVENTS_DUCK = "(SELECT *, epoch_us(ts) AS ts_us FROM events)"
TTL = 200_000


def events(spark, sf):
    return I.spread(I.table(spark, sf, "events")).withColumn("ts_us", F.expr(_US))


def open_sessions(spark, sf):
    return events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts_us").alias("created_us"))


_SESS = f"(SELECT user_id AS session_id, min(ts_us) AS created_us FROM {EVENTS_DUCK} e GROUP BY user_id)"
query("st_session", f"SELECT event_id, user_id AS session_id, CASE WHEN ts_us - created_us <= {TTL}000000 THEN 'CAPTURED' ELSE 'SESSION_NOT_FOUND' END AS frame_status FROM {EVENTS_DUCK} e JOIN {_SESS} s ON s.session_id = e.user_id")(
    lambda s, sf: ss.live_frames(events(s, sf).withColumnRenamed("user_id", "session_id"), open_sessions(s, sf), TTL).select("event_id", "session_id", "frame_status"))
query("st_active_sessions", f"SELECT count(*) AS active_sessions FROM {_SESS} s WHERE created_us <= 1704153600000000 AND 1704153600000000 - created_us <= {TTL}000000")(
    lambda s, sf: ss.active_sessions(open_sessions(s, sf), F.lit(1704153600000000), TTL))
query("win_capture_seq", f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS captures FROM {EVENTS_DUCK} e")(
    lambda s, sf: ss.capture_numbers(events(s, sf).select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_id"), "ts_us")).select("event_id", "captures"))
_GRAY = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(128 + 300 * x))"
query("win_frame_motion", f"""SELECT vec_id, coalesce(round(CASE WHEN p IS NOT NULL THEN least(list_sum(list_transform(range(1, 65), lambda i: abs(g[i] - p[i]))) / 64 / 40, 1.0) END + 1e-9, 4), -1.0) AS motion
FROM (SELECT vec_id, {_GRAY} AS g, lag({_GRAY}) OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) AS p FROM embeddings) t""")(
    lambda s, sf: ss.with_motion(I.table(s, sf, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("session_id"), F.col("vec_id").alias("ts_us"), F.transform("embedding", lambda x: F.floor(128 + 300 * x.cast("double")).cast("int")).alias("gray")))
    .select("vec_id", F.coalesce(F.round(F.col("motion") + 1e-9, 4), F.lit(-1.0)).alias("motion")))


@query("st_frame_pad")
def q_frame_pad(spark, sf):
    f = faces(spark, sf)
    doc = oi.primary_faces(f.filter("role = 'document'"), ["session_id"]).select("session_id", F.col("primary").alias("doc"), F.col("face_count").alias("doc_count"), F.lit(0).cast("long").alias("created_us"))
    live = f.filter("role = 'live'").select(
        "session_id", F.col("face_ord").alias("ts_us"), F.lit("live_camera").alias("source"), F.lit(1).cast("long").alias("face_count"), F.lit(1).cast("long").alias("live_count"),
        F.struct("embedding", "face_label", "image_sha").alias("live"), F.col("laplacian_variance").alias("flat_lap"), F.lit(0.1).alias("moire"), F.lit(0.01).alias("specular_frac"), "area_fraction",
        F.array(F.lit(100.0), F.lit(110.0), F.lit(120.0)).alias("channel_means"), F.transform("embedding", lambda x: F.floor(128 + 30 * x).cast("int")).alias("gray"))
    return ss.frame_results(live, doc).select("session_id", "ts_us", "pad_decision", "cmp_result", "similarity")


query("src_frames", f"SELECT user_id AS session_id, count(*) AS frames FROM events GROUP BY 1")(
    lambda s, sf: events(s, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("frames")))


def _hits(spark, sf):
    return events(spark, sf).select(rl.client_key(F.concat(F.lit(" user"), F.col("user_id").cast("string"), F.lit(" , proxy")), F.lit("")).alias("client"), F.col("event_id").alias("hit_id"), "ts_us")


# The recursive rule in SQL: with a limit of two, the state is the two last admitted times.
RATE_SQL = f"""WITH RECURSIVE h AS (SELECT 'user' || user_id AS client, event_id AS hit_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM {EVENTS_DUCK} e),
 w AS (SELECT client, hit_id, rn, true AS admitted, ts_us AS a1, CAST(NULL AS BIGINT) AS a2 FROM h WHERE rn = 1 UNION ALL
  SELECT h.client, h.hit_id, h.rn, w.a2 IS NULL OR h.ts_us - w.a2 > 21600000000, CASE WHEN w.a2 IS NULL OR h.ts_us - w.a2 > 21600000000 THEN h.ts_us ELSE w.a1 END, CASE WHEN w.a2 IS NULL OR h.ts_us - w.a2 > 21600000000 THEN w.a1 ELSE w.a2 END
  FROM w JOIN h ON h.client = w.client AND h.rn = w.rn + 1) SELECT client, hit_id, admitted FROM w"""
query("st_rate_limit", RATE_SQL)(
    lambda s, sf: rl.rate_limit(_hits(s, sf), 2, 21600).select("client", "hit_id", "admitted"))

# --- cases ------------------------------------------------------------------------------------------------

CASES = "SELECT o_orderkey AS doc_id, o_orderdate AS submitted_at, o_orderstatus, o_totalprice FROM {orders}"
CID = "SELECT o_orderkey AS doc_id, year(o_orderdate) AS y, printf('DS-%d-%06d', year(o_orderdate), row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)) AS case_id FROM orders"


def ided(spark, sf):
    return oc.allocate_ids(I.derive(spark, sf, CASES))


query("case_id_alloc", f"SELECT doc_id, case_id FROM ({CID}) c")(lambda s, sf: ided(s, sf).select("doc_id", "case_id"))


def created(spark, sf):
    """Pending cases, appended to the case log and read back."""
    path = work_folder(spark, "cases")
    oc.append_cases(oc.pending_cases(ided(spark, sf)), path)
    return oc.read_cases(spark, path)


def updated(spark, sf):
    """Both versions of the cases, appended one after the other, and the newest of each read back."""
    path, versions = work_folder(spark, "cases"), log(spark, sf)
    for part in ("decision = 'PENDING'", "decision <> 'PENDING'"):
        oc.append_cases(versions.filter(part), path)
    return oc.current_cases(oc.read_cases(spark, path))


query("sink_case_create", f"SELECT case_id, 'PENDING' AS decision, 'OPEN' AS reviewer_status, '{{}}' AS evidence_json FROM ({CID}) c")(
    lambda s, sf: created(s, sf).select("case_id", "decision", "reviewer_status", "evidence_json"))


def log(spark, sf):
    """Pending version of every case, and an analysed one for two of three."""
    p = oc.pending_cases(ided(spark, sf)).withColumns({n: F.lit(None).cast("double") for n in ("authenticity_estimate", "confidence", "evidence_quality")})
    k = F.col("doc_id")
    done = {
        "decision": F.when(k % 2 == 0, F.lit("PASS")).otherwise(F.lit("HIGH-RISK")), "document_type": F.lit("VISA"), "updated_at": F.col("submitted_at") + F.expr("INTERVAL 1 HOUR"),
        "confidence": (k % 97) / 97.0, "evidence_quality": (k % 89) / 89.0, "authenticity_estimate": F.when(k % 4 != 0, (k % 83) / 83.0),
        "evidence_json": F.when(k % 7 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(
            F.struct(F.lit("OK").alias("status")).alias("ocr"), F.struct(F.col("o_orderstatus").alias("overall")).alias("cross_validation"),
            F.struct(F.array(F.lit("first"), F.col("o_orderstatus")).alias("decision_reasons"), F.lit("look").alias("recommended_action")).alias("decision_engine"))))}
    # Both versions come from one row, so that cases are numbered once.
    versions = p.withColumn("_v", F.explode(F.when(k % 3 != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return versions.withColumns({n: F.when(F.col("_v") == 1, c).otherwise(F.col(n)) for n, c in done.items()}).drop("_v")


def current(spark, sf):
    return oc.current_cases(log(spark, sf))


def _sh(x, cond):
    return f"CASE WHEN {cond} THEN printf('%.4f', {x}) ELSE 'N/A' END"


CUR = f"""SELECT case_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' ELSE 'VISA' END AS document_type, CASE WHEN doc_id % 3 = 0 THEN 'PENDING' WHEN doc_id % 2 = 0 THEN 'PASS' ELSE 'HIGH-RISK' END AS decision,
 {_sh('doc_id % 83 / 83.0', 'doc_id % 3 <> 0 AND doc_id % 4 <> 0')} AS authenticity_estimate, {_sh('doc_id % 97 / 97.0', 'doc_id % 3 <> 0')} AS confidence, {_sh('doc_id % 89 / 89.0', 'doc_id % 3 <> 0')} AS evidence_quality, 'OPEN' AS reviewer_status FROM ({CID}) c"""
query("sink_case_update", f"SELECT case_id, decision, confidence FROM ({CUR}) c")(
    lambda s, sf: oc.case_summary(updated(s, sf)).select("case_id", "decision", "confidence"))
query("case_summary", f"SELECT case_id, document_type, decision, authenticity_estimate, confidence, evidence_quality, reviewer_status FROM ({CUR}) c")(lambda s, sf: oc.case_summary(current(s, sf)))
query("top_cases", f"SELECT case_id, decision FROM ({CUR}) c ORDER BY CAST(split_part(case_id, '-', 2) AS BIGINT) DESC, CAST(split_part(case_id, '-', 3) AS BIGINT) DESC LIMIT 50")(lambda s, sf: oc.newest(current(s, sf)).select("case_id", "decision"))
query("job_cases", f"SELECT decision, count(*) AS n FROM ({CUR}) c GROUP BY 1")(lambda s, sf: oc.case_summary(current(s, sf)).groupBy("decision").agg(F.count(F.lit(1)).alias("n")))
_HASJ = "doc_id % 3 <> 0 AND doc_id % 7 <> 0"
query("src_evidence_json", f"SELECT case_id, CASE WHEN {_HASJ} THEN 'OK' ELSE '' END AS ocr_status FROM ({CUR}) c")(
    lambda s, sf: current(s, sf).select("case_id", F.coalesce(oc.evidence_value(oc.parsed_evidence(F.col("evidence_json")), "$.ocr.status"), F.lit("")).alias("ocr_status")))
query("sink_evidence_json", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS evidence FROM documents")(
    lambda s, sf: I.table(s, sf, "documents").select("doc_id", oc.evidence_json(["doc_id", "lang", "n_chars"]).alias("evidence")))


def reported(spark, sf):
    c = current(spark, sf)
    return oc.reports(c.withColumns({n: oc.shown(F.col(n)) for n in ("authenticity_estimate", "confidence", "evidence_quality")}))


query("report_build", f"SELECT case_id, decision, coalesce(try_cast(confidence AS DOUBLE), -1.0) AS confidence, CASE WHEN {_HASJ} THEN 2 ELSE 0 END AS n_reasons, CASE WHEN {_HASJ} THEN 'look' ELSE '' END AS action FROM ({CUR}) c")(
    lambda s, sf: reported(s, sf).select("case_id", "report.decision", F.coalesce("report.confidence", F.lit(-1.0)).alias("confidence"), F.size("report.reasons").alias("n_reasons"), F.coalesce("report.recommended_action", F.lit("")).alias("action")))
query("report_markdown", f"SELECT case_id, '# Screening Report — ' || case_id AS first_line, '**Decision:** ' || decision AS decision_line, CASE WHEN {_HASJ} THEN '- first' ELSE '' END AS reason_line FROM ({CUR}) c")(
    lambda s, sf: reported(s, sf).withColumn("m", F.split(oc.markdown(F.col("report")), "\n")).select(
        "case_id", F.col("m")[0].alias("first_line"), F.col("m")[3].alias("decision_line"), F.when(F.array_contains("m", "- first"), F.lit("- first")).otherwise(F.lit("")).alias("reason_line")))


@query("sink_report", f"""SELECT case_id, decision AS json_decision, '# Screening Report — ' || case_id AS first_line, CASE WHEN {_HASJ} THEN '**Recommended action:** look' ELSE '**Recommended action:** —' END AS action_line FROM ({CUR}) c""")
def q_report(spark, sf):
    """Reports of all cases, written as JSON and Markdown and read back."""
    path = work_folder(spark, "reports")
    oc.write_reports(reported(spark, sf), path, shards=8)
    lines = F.split("markdown", "\n")
    return oc.read_reports(spark, path).select(
        "case_id", F.get_json_object("json", "$.decision").alias("json_decision"), lines[0].alias("first_line"),
        F.filter(lines, lambda x: x.startswith("**Recommended action"))[0].alias("action_line"))


# --- audit ----------------------------------------------------------------------------------------------------

ACT = """SELECT event_id AS id, 'case-' || CAST(user_id AS STRING) AS case_id, event_type AS action, CASE WHEN event_id % 3 = 0 THEN 'officer' ELSE 'system' END AS actor, 'value ' || CAST(CAST(floor(value) AS INT) AS STRING) || ' — ok' AS summary FROM {events}"""
BODY = "'{\"action\":\"' || action || '\",\"actor\":\"' || actor || '\",\"case_id\":\"' || case_id || '\",\"summary\":\"' || summary || '\"}'"
CHAIN = f"""WITH RECURSIVE a AS (SELECT *, {BODY} AS body, row_number() OVER (PARTITION BY case_id ORDER BY id) AS rn FROM ({I.plain(ACT)}) x),
 c AS (SELECT id, case_id, rn, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || body) AS entry_hash FROM a WHERE rn = 1 UNION ALL
  SELECT a.id, a.case_id, a.rn, c.entry_hash, sha256(c.entry_hash || '|' || a.body) FROM c JOIN a ON a.case_id = c.case_id AND a.rn = c.rn + 1)"""


def appended(spark, sf):
    return oa.append(I.derive(spark, sf, ACT))


def chained(spark, sf):
    """The chains as a table that is written once: every step over them reads them several times."""
    return stored(appended(spark, sf), "chains")


def tampered(spark, sf):
    """Chains whose events of every 500th id were edited after hashing."""
    return chained(spark, sf).withColumn("summary", F.when(F.col("id") % 500 == 7, F.lit("edited")).otherwise(F.col("summary")))


query("audit_hash", f"SELECT id, sha256(repeat('0', 64) || '|' || {BODY}) AS entry_hash FROM ({I.plain(ACT)}) x")(
    lambda s, sf: I.derive(s, sf, ACT).select("id", oa.entry_hash(F.lit(oa.GENESIS_HASH), oa.canonical()).alias("entry_hash")))
query("audit_append", f"{CHAIN} SELECT id, case_id, prev_hash, entry_hash FROM c")(lambda s, sf: appended(s, sf).select("id", "case_id", "prev_hash", "entry_hash"))
query("win_prev_hash", f"{CHAIN} SELECT id, prev_hash AS expected_prev, true AS link_ok FROM c")(lambda s, sf: oa.links(chained(s, sf), bucket_rows=1000).select("id", "expected_prev", "link_ok"))
_STAT = f"""{CHAIN} SELECT c.case_id, count(*) AS checked, coalesce(min(CASE WHEN id % 500 = 7 THEN id END), -1) AS broken_event, CASE WHEN count_if(id % 500 = 7) > 0 THEN 'BROKEN' ELSE 'VALID' END AS chain_status, max_by(entry_hash, id) AS tip_hash FROM c GROUP BY c.case_id"""
_AS = ["case_id", "checked", "broken_event", "chain_status", "tip_hash"]
query("agg_chain_status", _STAT)(lambda s, sf: oa.verify(tampered(s, sf), bucket_rows=1000).withColumn("broken_event", F.coalesce("broken_event", F.lit(-1))).select(*_AS))
query("audit_verify", f"{CHAIN} SELECT id, id % 500 <> 7 AS content_ok FROM c")(lambda s, sf: oa.links(tampered(s, sf), bucket_rows=1000).select("id", "content_ok"))
query("audit_by_case", f"SELECT case_id, id, rank FROM (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS rank FROM ({I.plain(ACT)}) x) y")(
    lambda s, sf: oa.by_case(I.derive(s, sf, ACT)).select("case_id", "id", F.col("rank").cast("long").alias("rank")))
query("job_audit", f"{CHAIN} SELECT chain_status, count(*) AS chains FROM (SELECT case_id, CASE WHEN count_if(id % 500 = 7) > 0 THEN 'BROKEN' ELSE 'VALID' END AS chain_status FROM c GROUP BY case_id) z GROUP BY 1")(
    lambda s, sf: jobs.audit_job(tampered(s, sf)).groupBy("chain_status").agg(F.count(F.lit(1)).alias("chains")))

# The tree over all chains, with 16 nodes to a node; a level is there while the one below has more than one.
FANNED = 16
_LEVEL = "l{k} AS (SELECT {k} AS level, idx // 16 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM l{b} WHERE (SELECT count(*) FROM l{b}) > 1 GROUP BY idx // 16)"
TREE = f"""{CHAIN}, tips AS (SELECT case_id, max_by(entry_hash, id) AS tip, count(*) AS n FROM c GROUP BY case_id),
 l0 AS (SELECT 0 AS level, row_number() OVER (ORDER BY case_id) - 1 AS idx, sha256(case_id || '|' || tip || '|' || n) AS hash FROM tips), {', '.join(_LEVEL.format(k=k, b=k - 1) for k in range(1, 6))},
 nodes AS ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(6))})"""
query("audit_tree", f"{TREE} SELECT level, CAST(idx AS BIGINT) AS idx, hash FROM nodes")(
    lambda s, sf: ht.tree(ht.leaves(chained(s, sf)), FANNED).select("level", "idx", "hash"))
query("audit_anchor", f"{TREE} SELECT *, sha256(previous || '|' || root || '|' || cases) AS anchor FROM (SELECT count_if(level = 0) AS cases, max_by(hash, level) AS root, repeat('0', 64) AS previous FROM nodes) a")(
    lambda s, sf: ht.anchor(ht.tree(ht.leaves(chained(s, sf)), FANNED)))


@query("audit_proof", f"{TREE} SELECT case_id, (SELECT max_by(hash, level) FROM nodes) AS root FROM tips")
def q_proof(spark, sf):
    p = ht.proofs(ht.tree(ht.leaves(chained(spark, sf)), FANNED), FANNED)
    return p.select("case_id", ht.proved_root(F.col("leaf"), F.col("proof")).alias("root"))


@query("audit_anchor_check", f"""SELECT case_id, CASE WHEN gone OR now_n = 0 THEN 'MISSING' WHEN now_n = kept_n THEN 'VALID' WHEN now_n > kept_n THEN 'EXTENDED' ELSE 'TRUNCATED' END AS anchor_status FROM (
 SELECT case_id, any_value(user_id) % 11 = 3 AS gone, CASE WHEN any_value(user_id) % 7 = 2 THEN greatest(count(*) - 2, 0) ELSE count(*) END AS now_n,
  CASE WHEN any_value(user_id) % 5 = 1 THEN least(count(*), 3) ELSE count(*) END AS kept_n FROM (SELECT 'case-' || user_id AS case_id, user_id FROM events) x GROUP BY case_id) y""")
def q_anchor_check(spark, sf):
    """Anchored while every fifth case had three events; since then cases and ends of cases were lost."""
    d = stored(oa.by_case(chained(spark, sf)), "ranked").withColumn("u", F.substring("case_id", 6, 20).cast("long"))
    size = d.groupBy("case_id").agg(F.count(F.lit(1)).alias("size"))
    now = d.join(size, "case_id").filter("u % 11 <> 3 AND (u % 7 <> 2 OR rank <= size - 2)")
    return ht.compared(now, ht.leaves(d.filter("u % 5 <> 1 OR rank <= 3")))


query("audit_broken_at", f"{CHAIN} SELECT case_id, count(*) AS checked, coalesce(min(CASE WHEN id % 500 = 7 THEN rn - 1 END), -1) AS broken_at FROM c GROUP BY case_id")(
    lambda s, sf: oa.broken_at(oa.links(tampered(s, sf))).withColumn("broken_at", F.coalesce("broken_at", F.lit(-1).cast("long"))))


def _detail(spark, sf):
    c = I.derive(spark, sf, ACT).select("case_id").distinct()
    return oc.case_detail(c, chained(spark, sf))


query("join_case_audit", f"{CHAIN} SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS rank, count(*) OVER (PARTITION BY case_id) AS n_events, entry_hash FROM c")(
    lambda s, sf: _detail(s, sf).select("case_id", "id", "rank", "n_events", "entry_hash"))
query("case_detail", f"{CHAIN} SELECT case_id, count(*) AS n_events, max_by(entry_hash, id) AS last_hash FROM c GROUP BY case_id")(
    lambda s, sf: _detail(s, sf).filter("rank = n_events").select("case_id", "n_events", F.col("entry_hash").alias("last_hash")))
