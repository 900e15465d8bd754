"""Streams over all events: limits, sessions and frames by keyed state machines, played from files in shuffled batches."""

from pyspark.sql import functions as F

from idsieve.queries import cases as qc, inputs as I
from idsieve.queries.registry import query
from idsieve.streaming import rate_limit as rl, sessions as ss
from idsieve.streaming.replay import replayed

DAY = 86_400_000_000
PARTS, DELAY = 3, "40 days"  # a batch holds a third of the month, and rows come up to a day late


def _arrival(rows, late_us=DAY):
    """Place of a row in its month, delayed by up to a day by its number."""
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    late = F.pmod(F.xxhash64("_id"), F.lit(1000)) / 1000 * late_us
    return rows.withColumn("_arrival", (F.col("ts_us") + late - F.lit(first or 0)) / F.lit((last or 0) + late_us - (first or 0) + 1))


def _played(spark, rows, number, beat, make, name):
    """``beat`` is a row far ahead, of a key that is dropped again."""
    timed = _arrival(rows.withColumn("_id", F.col(number))).drop("_id")
    last = spark.createDataFrame([beat], rows.schema).withColumn("_arrival", F.lit(1.0))
    return replayed(timed, F.col("_arrival"), PARTS, last, make, name)


_END = 2_000_000_000_000_000

query("st_rate_limit_stream", qc.RATE_SQL)(
    lambda s, sf: _played(s, qc._hits(s, sf), "hit_id", ("beat", -1, _END), lambda d: rl.rate_limit_in_order(d, 2, 21600, DELAY, 21_600_000), "st_rate_limit")
    .filter("client <> 'beat'").select("client", "hit_id", "admitted"))

# --- sessions: what a user does, as events of four kinds -----------------------------------------------

TTL = 200_000  # seconds
_EVENT = """SELECT concat('u', CAST(user_id AS STRING)) AS session_id, event_id, ts_us, kind, CASE WHEN kind = 'open' THEN concat('case', CAST(event_id AS STRING)) END AS case_id,
 CASE WHEN kind = 'capture' THEN {gray} END AS gray, CASE WHEN kind = 'attach' THEN event_id % 4 END AS doc_count, CASE WHEN kind = 'attach' THEN {vec} END AS doc_embedding,
 CASE WHEN kind = 'attach' THEN CASE WHEN event_id % 9 = 0 THEN 'POOR' ELSE 'GOOD' END END AS doc_label, CASE WHEN kind = 'attach' THEN CASE WHEN event_id % 10 = 0 THEN 'same' ELSE CAST(event_id AS STRING) END END AS doc_sha
 FROM (SELECT *, CASE event_id % 17 WHEN 0 THEN 'open' WHEN 8 THEN 'open' WHEN 5 THEN 'attach' WHEN 9 THEN 'attach' WHEN 12 THEN 'close' ELSE 'capture' END AS kind FROM {src}) k"""
# Doubles of the arrays; the live side of a frame is a vector of the same form.
_GRAY_SPARK = "transform(sequence(0, 15), i -> CAST(((event_id * 37 + i * 11) % 64) AS DOUBLE))"
_GRAY_DUCK = "list_transform(range(0, 16), lambda i: CAST(((event_id * 37 + i * 11) % 64) AS DOUBLE))"
_VEC_SPARK = "transform(sequence(1, 4), i -> CAST((event_id * (i + 3)) % 7 AS DOUBLE) - 2.5)"
_VEC_DUCK = "list_transform(range(1, 5), lambda i: CAST((event_id * (i + 3)) % 7 AS DOUBLE) - 2.5)"
EVENTS_SQL = _EVENT.format(gray=_GRAY_DUCK, vec=_VEC_DUCK, src=qc.EVENTS_DUCK)

# Lives by window: an event belongs to the newest opening before it, if nothing closed that and its time is not up.
LIFE = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, CASE kind WHEN 'open' THEN 1 WHEN 'attach' THEN 2 WHEN 'capture' THEN 3 ELSE 4 END, event_id) AS i FROM ({EVENTS_SQL}) a),
 o AS (SELECT *, max(CASE WHEN kind = 'open' THEN i END) OVER (PARTITION BY session_id ORDER BY i) AS oi, coalesce(max(CASE WHEN kind = 'close' THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ci,
   min(CASE WHEN kind IN ('open', 'close') THEN ts_us END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended FROM e),
 l AS (SELECT o.*, b.ts_us AS created_us, b.case_id AS life_case, coalesce(o.oi > o.ci AND o.ts_us - b.ts_us <= {TTL}000000, false) AS alive FROM o LEFT JOIN e b ON b.session_id = o.session_id AND b.i = o.oi),
 n AS (SELECT *, sum(CASE WHEN alive AND kind = 'capture' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, oi ORDER BY i) AS taken, max(CASE WHEN alive AND kind = 'attach' THEN i END) OVER (PARTITION BY session_id, oi ORDER BY i) AS ai,
   sum(CASE WHEN alive AND kind = 'capture' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, oi) AS all_taken FROM l),
 c AS (SELECT n.*, lag(gray) OVER (PARTITION BY session_id, oi, alive, kind ORDER BY i) AS prev FROM n)"""
SESSION_SQL = f"""{LIFE}
SELECT session_id, event_id, ts_us, kind, CASE kind WHEN 'open' THEN 'READY' WHEN 'attach' THEN CASE WHEN alive THEN 'ATTACHED' ELSE 'NOT_FOUND' END WHEN 'close' THEN CASE WHEN alive THEN 'CLOSED' ELSE 'NOT_FOUND' END
  ELSE CASE WHEN alive THEN 'CAPTURED' ELSE 'SESSION_NOT_FOUND' END END AS status, CASE WHEN alive THEN life_case ELSE '' END AS case_id, CAST(CASE WHEN alive THEN taken ELSE -1 END AS BIGINT) AS captures, alive AND ai IS NOT NULL AS document_attached FROM n
UNION ALL SELECT session_id, -1, created_us + {TTL}000000, 'expire', 'EXPIRED', life_case, CAST(all_taken AS BIGINT), false FROM n WHERE kind = 'open' AND (ended IS NULL OR ended > created_us + {TTL}000000)"""


def session_log(spark, sf):
    rows = I.derive_from(spark, _EVENT.format(gray=_GRAY_SPARK, vec=_VEC_SPARK, src="{src}"), src=qc.events(spark, sf))
    return _played(spark, rows, "event_id", ("beat", -1, _END, "close", *(None,) * 6), lambda d: ss.session_stream(d, TTL, DELAY, 3_600_000), "st_session").filter("session_id <> 'beat'")


query("st_session_stream", SESSION_SQL)(lambda s, sf: session_log(s, sf).select(
    "session_id", F.coalesce("event_id", F.lit(-1).cast("long")).alias("event_id"), "ts_us", "kind", "status", F.coalesce("case_id", F.lit("")).alias("case_id"),
    F.coalesce("captures", F.lit(-1).cast("long")).alias("captures"), F.coalesce("document_attached", F.lit(False)).alias("document_attached")))

_LIVE = "SELECT event_id, {vec} AS v, {gray} AS gray, CASE WHEN event_id % 13 = 0 THEN 'POOR' ELSE 'GOOD' END AS label, CASE WHEN event_id % 4 = 0 THEN 'same' ELSE concat('l', CAST(event_id AS STRING)) END AS sha, CAST(event_id % 15 % 3 AS BIGINT) AS faces FROM {src}"
_COS = "list_sum(list_transform(range(1, 5), lambda i: d.doc_embedding[i] * v[i])) / ((sqrt(list_sum(list_transform(d.doc_embedding, lambda x: x * x))) + 1e-8) * (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8))"
FRAME_SQL = f"""{LIFE}, f AS (SELECT c.session_id, c.event_id, alive, faces, label, sha, v, coalesce(d.doc_count, 0) AS dn, d.doc_embedding, d.doc_label, d.doc_sha,
  CASE WHEN prev IS NOT NULL THEN least(list_sum(list_transform(range(1, 17), lambda i: abs(prev[i] - x.gray[i]))) / 16 / 40, 1.0) END AS motion,
  CASE WHEN d.doc_count = 1 AND faces = 1 THEN greatest(least(({_COS} + 1) / 2, 1.0), 0.0) END AS sim
 FROM c JOIN ({_LIVE.format(vec=_VEC_DUCK, gray=_GRAY_DUCK, src=qc.EVENTS_DUCK)}) x ON x.event_id = c.event_id LEFT JOIN e d ON d.session_id = c.session_id AND d.i = c.ai AND c.alive WHERE c.kind = 'capture')
SELECT session_id, event_id, CASE WHEN alive THEN 'CAPTURED' ELSE 'SESSION_NOT_FOUND' END AS frame_status, CASE WHEN alive THEN coalesce(round(motion + 1e-9, 4), -1.0) ELSE -1.0 END AS motion,
 CASE WHEN dn = 0 OR faces = 0 THEN 'NOT_AVAILABLE' WHEN dn > 1 OR faces > 1 THEN 'INCONCLUSIVE' WHEN doc_sha = sha OR doc_embedding = v THEN 'INCONCLUSIVE' WHEN sim >= 0.96 AND (label = 'POOR' OR doc_label = 'POOR') THEN 'INCONCLUSIVE'
  WHEN sim >= 0.96 THEN 'MATCH' WHEN sim <= 0.7 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS cmp_result, coalesce(round(sim + 1e-9, 4), -1.0) AS similarity FROM f"""


def frames(spark, sf):
    live = I.derive_from(spark, _LIVE.format(vec=_VEC_SPARK, gray=_GRAY_SPARK, src="{src}"), src=qc.events(spark, sf))
    return live.select(
        "event_id", "gray", F.lit("live_camera").alias("source"), F.col("faces").alias("face_count"), F.lit(200.0).alias("flat_lap"), F.lit(0.1).alias("moire"), F.lit(0.01).alias("specular_frac"),
        F.lit(0.2).alias("area_fraction"), F.array(F.lit(100.0), F.lit(110.0), F.lit(120.0)).alias("channel_means"), F.col("faces").alias("live_count"),
        F.struct(F.col("v").alias("embedding"), F.col("label").alias("face_label"), F.col("sha").alias("image_sha")).alias("live"))


query("st_frame_stream", FRAME_SQL)(lambda s, sf: ss.frame_stream(session_log(s, sf), frames(s, sf)).select(
    "session_id", "event_id", "frame_status", F.coalesce(F.round(F.col("motion") + 1e-9, 4), F.lit(-1.0)).alias("motion"), "cmp_result",
    F.coalesce("similarity", F.lit(-1.0)).alias("similarity")))
