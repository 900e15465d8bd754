"""Intake, images, audit chains, rate limit, skew helpers, streams."""

import random
import struct
import zlib
from collections import deque

import pytest
from pyspark.sql import functions as F

from idsieve.operators import audit as oa, cells as oc, intake as oi, ordered
from idsieve.settings import Settings
from idsieve.sources import files as sfiles
from idsieve.streaming import rate_limit as rl


def png(width, height, rgb=(10, 200, 30)):
    raw = b"".join(b"\x00" + bytes(rgb) * width for _ in range(height))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("name,content,code", [
    ("doc.png", b"MZ" + b"\x00" * 90, "DANGEROUS_CONTENT"), ("x.png", b" \n<html>hello there", "DANGEROUS_CONTENT"),
    ("photo.jpg", png(4, 4), "MIME_MISMATCH"), ("a.png", b"", "EMPTY_FILE"), ("a.gif", png(4, 4), "BAD_EXTENSION"),
    ("a.png", b"hello world, no picture", "BAD_SIGNATURE"), ("a.png", png(4, 4), None), ("../../a.png", png(4, 4), None),
])
def test_codes(spark, name, content, code):
    d = spark.createDataFrame([("p", name, bytearray(content))], "path string, filename string, content binary")
    r = oi.validate(d).first()
    assert r.code == code and "/" not in r.safe_name


def test_limits(spark):
    d = spark.createDataFrame([("p", "a.png", bytearray(png(4, 4)))], "path string, filename string, content binary")
    assert oi.validate(d, Settings(max_upload_bytes=10)).first().code == "FILE_TOO_LARGE"
    assert oi.validate(d, Settings(max_image_pixels=15)).first().code == "TOO_MANY_PIXELS"


def webp(kind, body):
    chunk = kind + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


@pytest.mark.parametrize("content", [
    webp(b"VP8 ", b"\x10\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 700, 300) + b"\x00" * 8),
    webp(b"VP8L", b"\x2f" + struct.pack("<I", 699 | 299 << 14) + b"\x00" * 8),
    webp(b"VP8X", b"\x00" * 4 + (699).to_bytes(3, "little") + (299).to_bytes(3, "little")),
])
def test_webp_sizes(spark, content):
    d = spark.createDataFrame([("p", "a.webp", bytearray(content))], "path string, filename string, content binary")
    none = spark.createDataFrame([], "path string, width int, height int")
    for decoded in (None, none):
        r = oi.validate(d, decoded=decoded).first()
        assert (r.code, r.width, r.height) == (None, 700, 300)
    assert oi.validate(d, Settings(max_image_pixels=200_000)).first().code == "TOO_MANY_PIXELS"
    cut = spark.createDataFrame([("p", "a.webp", bytearray(content[:20]))], "path string, filename string, content binary")
    assert oi.validate(cut).first().code == "CORRUPT_IMAGE"


def test_hsv_is_whole(spark):
    d = spark.createDataFrame([(10.0, 20.0, 200.0), (11.0, 10.0, 200.0), (200.0, 101.0, 100.0), (0.0, 0.0, 0.0)], "blue double, green double, red double")
    got = [(r.h, r.s, r.v) for r in oc.hsv(d).select("h", "s", "v").collect()]
    assert got == [(2.0, 242.0, 200.0), (0.0, 242.0, 200.0), (120.0, 128.0, 200.0), (0.0, 0.0, 0.0)]


def test_images_to_cells(spark, tmp_path):
    (tmp_path / "ok.png").write_bytes(png(5, 3))
    (tmp_path / "bad.png").write_bytes(png(5, 3)[:30])
    images = sfiles.read_images(spark, str(tmp_path))
    cells = sfiles.gray_cells(images, band=2)
    assert cells.count() == 15
    assert cells.first().value == round(0.114 * 30 + 0.587 * 200 + 0.299 * 10)
    colors = oc.color_fractions(oc.hsv(sfiles.color_cells(images).withColumn("doc_id", F.lit(1)))).first()
    assert colors.green_frac == 1.0
    files = sfiles.read_files(spark, str(tmp_path), "*.png")
    codes = {r.filename: r.code for r in oi.validate(files, decoded=images).collect()}
    assert codes == {"ok.png": None, "bad.png": "CORRUPT_IMAGE"}


def test_block_copies(spark):
    rnd = random.Random(5)
    img = [[float(rnd.randrange(256)) for _ in range(64)] for _ in range(64)]
    for r in range(8):
        for c in range(8):
            img[48 + r][56 + c] = img[r][c]
    data = [(1, "gray", r, c, img[r][c]) for r in range(64) for c in range(64)]
    d = spark.createDataFrame(data, "doc_id long, plane string, r int, c int, value double")
    assert oc.block_copies(d).first().copy_move_indicators == pytest.approx(1.0)
    near = d.filter("NOT (r >= 48 AND c >= 56)")
    assert oc.block_copies(near).count() == 0


EVENTS = "id long, case_id string, action string, actor string, summary string"


def chain(spark, n=300, cases=3):
    rows = [(i, f"c{i % cases}" if i % 3 else "c0", "analyze", "system", f"s {i} → é") for i in range(n)]
    return oa.append(spark.createDataFrame(rows, EVENTS)).cache()


@pytest.mark.parametrize("column", ["summary", "actor", "action", "entry_hash", "prev_hash"])
def test_every_edit_is_found(spark, column):
    c = chain(spark)
    assert {r.chain_status for r in oa.verify(c, bucket_rows=7).collect()} == {"VALID"}
    bad = c.withColumn(column, F.when(F.col("id") == 123, F.concat(F.lit("x"), F.substring(column, 2, 99))).otherwise(F.col(column)))
    out = oa.verify(bad, bucket_rows=7).filter("chain_status = 'BROKEN'").collect()
    assert len(out) == 1 and out[0].broken_event == 123


def test_missing_row_is_found_and_append_continues(spark):
    c = chain(spark)
    assert oa.verify(c.filter("id <> 150"), bucket_rows=7).filter("chain_status = 'BROKEN'").count() == 1
    tips = c.groupBy("case_id").agg(F.max_by("entry_hash", "id").alias("tip"))
    more = oa.append(spark.createDataFrame([(1000, "c0", "review", "officer", "x")], EVENTS), tips)
    assert oa.verify(c.unionByName(more), bucket_rows=50).filter("chain_status <> 'VALID'").count() == 0


def test_partitioning_does_not_change_the_chain(spark):
    c = chain(spark)
    again = oa.append(c.drop("prev_hash", "entry_hash").repartition(7, F.rand(1)))
    assert {(r.id, r.entry_hash) for r in again.collect()} == {(r.id, r.entry_hash) for r in c.collect()}


def brute_rate(hits, limit, us):
    out, taken = {}, {}
    for client, hid, t in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        out[hid] = rl.admit([t], taken.setdefault(client, deque()), limit, us)[0]
    return out


def some_hits(n=600):
    rnd = random.Random(9)
    return [("hot" if rnd.random() < 0.4 else f"u{rnd.randrange(5)}", i, rnd.randrange(4000) * 500_000) for i in range(n)]


@pytest.mark.parametrize("limit", [1, 3, 30, 0])
def test_rate_limit_batch(spark, limit):
    hits = some_hits()
    got = {r.hit_id: r.admitted for r in rl.rate_limit(
        spark.createDataFrame(hits, "client string, hit_id long, ts_us long"), limit, 60).collect()}
    assert got == (brute_rate(hits, limit, 60_000_000) if limit else {h[1]: True for h in hits})


def test_rate_limit_stream_agrees(spark, tmp_path):
    hits = sorted(some_hits(200), key=lambda h: (h[2], h[1]))
    d = spark.createDataFrame(hits, "client string, hit_id long, ts_us long")
    src = tmp_path / "in"
    d.coalesce(1).write.parquet(str(src))
    stream = rl.rate_limit_stream(spark.readStream.schema(d.schema).parquet(str(src)), 3, 60)
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.hit_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute_rate(hits, 3, 60_000_000)


def test_rate_limit_stream_in_many_chunks(spark, tmp_path):
    hits = some_hits(200)
    random.Random(8).shuffle(hits)
    d = spark.createDataFrame(hits, "client string, hit_id long, ts_us long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = rl.rate_limit_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 3, 60)
        (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.hit_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute_rate(sorted(hits, key=lambda h: (h[2], h[1])), 3, 60_000_000)


def test_ordered_helpers_match_plain_order(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}", i, rnd.randrange(10_000)) for i in range(500)]
    d = spark.createDataFrame(data, "k string, id long, v long")
    want_top = {k: [x[1] for x in sorted((x for x in data if x[0] == k), key=lambda x: (-x[2], x[1]))[:7]] for k in {x[0] for x in data}}
    top = ordered.top_k_per_key(d, ["k"], [F.desc("v"), F.asc("id")], 7, salts=5).collect()
    got = {}
    for r in sorted(top, key=lambda r: (r.k, r.rank)):
        got.setdefault(r.k, []).append(r.id)
    assert got == want_top
    lagged = ordered.lag_in_order(d, ["k"], "id", ["v"], F.floor(F.col("id") / 50)).collect()
    numbered = {r.id: r.seq for r in ordered.number_in_order(d, ["k"], [F.col("id")], F.floor(F.col("id") / 50)).collect()}
    for k in want_top:
        own = sorted((x for x in data if x[0] == k), key=lambda x: x[1])
        assert [numbered[x[1]] for x in own] == list(range(1, len(own) + 1))
        prev = {own[i][1]: (own[i - 1][2] if i else None) for i in range(len(own))}
        assert all(prev[r.id] == r.prev_v for r in lagged if r.k == k)


def test_ranges_split_a_busy_minute(spark):
    rnd = random.Random(12)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}", i, 600 + rnd.randrange(60) if i % 2 else rnd.randrange(500_000), i % 7 and i) for i in range(3_000)]
    d = spark.createDataFrame(data, "k string, id long, sec long, v long").withColumn("at", F.timestamp_seconds("sec"))
    sizes = d.groupBy(ordered.ranges(d, [F.col("at"), F.col("id")], 20)).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 2 * 3_000 / 20
    numbered = {r.id: r.seq for r in ordered.number_in_order(d, ["k"], ["at", "id"]).collect()}
    lagged = {r.id: r.prev_v for r in ordered.lag_in_order(d, ["k"], "id", ["v"]).collect()}
    for k in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1]))
        assert [numbered[x[1]] for x in own] == list(range(1, len(own) + 1))
        own = sorted((x for x in data if x[0] == k), key=lambda x: x[1])
        assert [lagged[x[1]] for x in own] == [None, *[x[3] for x in own[:-1]]]


def test_ranges_of_ties_nulls_and_nothing(spark):
    d = spark.createDataFrame([("a", i, None if i < 5 else "x") for i in range(40)], "k string, id long, o string")
    got = {r.id: r.seq for r in ordered.number_in_order(d, ["k"], ["o", "id"]).collect()}
    assert got == {i: i + 1 for i in range(40)}
    assert ordered.number_in_order(d.filter("false"), ["k"], ["o", "id"]).count() == 0


def test_case_numbers_go_on(spark):
    d = spark.createDataFrame([(i, 1_600_000_000 + (i % 3) * 40_000_000) for i in range(30)], "doc_id long, t long").withColumn("submitted_at", F.timestamp_seconds("t"))
    taken = spark.createDataFrame([(2020, 7), (2020, 5), (2099, 1)], "year int, taken long")
    from idsieve.operators import cases as ocases
    ids = sorted(r.case_id for r in ocases.allocate_ids(d, taken).collect())
    assert ids[0] == "DS-2020-000008" and len(set(ids)) == 30 and sum(i.startswith("DS-2021") for i in ids) == 10


@pytest.mark.parametrize("limit,window", [(1, 5), (3, 20), (5, 60), (30, 60)])
def test_rate_limit_segments(spark, limit, window):
    rnd = random.Random(limit)
    hits, t = [], {}
    for i in range(3_000):  # a hot client that is never silent, with bursts; others in between; many equal times
        client = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(6)}"
        step = rnd.choice([0, 1, 2, 9, 15]) if i % 700 > 150 else rnd.choice([0, 0, 1])
        t[client] = t.get(client, 0) + step * 500_000
        hits.append((client, i, t[client]))
    rnd.shuffle(hits)
    d = spark.createDataFrame(hits, "client string, hit_id long, ts_us long")
    got = [(r.hit_id, r.admitted) for r in rl.rate_limit(d, limit, window).collect()]
    assert len(got) == len(hits) and dict(got) == brute_rate(hits, limit, window * 1_000_000)


def test_a_client_that_is_never_silent_is_cut(spark):
    hits = [("hot", i, i * 20_000_000 + (i % 3) * 1_000_000) for i in range(4_000)]
    d = spark.createDataFrame(hits, "client string, hit_id long, ts_us long").withColumn("_b", F.floor(F.col("ts_us") / 60_000_000))
    found = rl.segments(d, 10, 60_000_000)
    assert found.select("_segment").distinct().count() > 1_000
    assert rl.rate_limit(d.drop("_b"), 10, 60).filter("NOT admitted").count() == 0


def jpeg(width, height, before=b"", frame=0xC0):
    def segment(kind, body):
        return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body

    return (b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\x01" * 9) + before + segment(0xDB, b"q" * 65) + segment(frame, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00" * 3)
            + segment(0xDA, b"x" * 10) + b"data" * 20 + b"\xff\xd9")


@pytest.mark.parametrize("before", [b"", b"\xff\xe1\xff\xff" + b"\xff\xc0\x00\x11" * 16383 + b"z", b"\xff\xff\xff\xfe\x00\x04ab", b"\xff\x01", (b"\xff\xe2\xff\xff" + b"i" * 65533) * 40])
@pytest.mark.parametrize("frame", [0xC0, 0xC2, 0xCF])
def test_jpeg_sizes(before, frame):
    assert oi.jpeg_frame(memoryview(jpeg(640, 480, before, frame))) == (640, 480)


@pytest.mark.parametrize("content", [b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", jpeg(5, 5)[:90], b"\xff\xd8\xff\xe0\x00\x00" + b"a" * 50, b"\xff\xd8" + b"prose" * 9, jpeg(5, 5, frame=0xC4)])
def test_jpeg_without_a_frame(content):
    assert oi.jpeg_frame(memoryview(content)) is None


def test_jpeg_codes(spark):
    d = spark.createDataFrame([(str(i), "a.jpg", bytearray(c)) for i, c in enumerate([jpeg(300, 200), jpeg(300, 200)[:60], jpeg(60_000, 60_000), jpeg(0, 10)])], "path string, filename string, content binary")
    got = {r.path: (r.code, r.width) for r in oi.validate(d).collect()}
    assert got == {"0": (None, 300), "1": ("CORRUPT_IMAGE", None), "2": ("TOO_MANY_PIXELS", 60_000), "3": ("BAD_DIMENSIONS", 0)}


def test_long_names_stay_apart(spark):
    d = spark.createDataFrame([("p", "x" * 250 + "a.png", bytearray(png(4, 4))), ("q", "x" * 250 + "b.png", bytearray(png(4, 4)))], "path string, filename string, content binary")
    r = oi.with_header(d).collect()
    assert r[0].safe_name == r[1].safe_name == "x" * 200 and {x.full_name for x in r} == {"x" * 250 + "a.png", "x" * 250 + "b.png"}
    assert oi.public_projection(spark.createDataFrame([("y" * 900,)], "full_text string"), None).first().text_preview == "y" * 900
