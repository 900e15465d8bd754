"""A session stream wakes a session a few times, not once for each of its events; missing values stay missing."""

import pandas as pd

from idsieve.streaming import in_order, sessions as ss

EVENTS = ("session_id string, event_id long, ts_us long, kind string, case_id string, gray array<double>, "
          "doc_count long, doc_embedding array<double>, doc_label string, doc_sha string")
SECOND = 1_000_000


def _fed(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    with in_order.rocks(spark):
        q = (ss.session_stream(source, 5, "7 seconds", 2_000).writeStream.format("parquet").option("path", str(path / "out"))
             .option("checkpointLocation", str(path / "cp")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    timers = sum(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in q.recentProgress)
    return timers, spark.read.parquet(str(path / "out")).collect()


def test_openings_do_not_wake_their_session_each(spark, tmp_path):
    none = (None,) * 4
    rows = [("s", 2 * i, 100 * SECOND + 10 * i * SECOND, "open", f"c{i}", None, *none) for i in range(40)]
    rows += [("s", 2 * i + 1, 101 * SECOND + 10 * i * SECOND, "capture", None, [float(i)] if i % 2 else None, *none) for i in range(40)]
    timers, _ = _fed(spark, tmp_path, rows)
    more, out = _fed(spark, tmp_path, [("beat", -1, 5_000 * SECOND, "close", None, None, *none)])
    got = [r for r in out if r.session_id == "s"]
    assert [sum(r.status == x for r in got) for x in ("READY", "CAPTURED", "EXPIRED")] == [40, 40, 40]
    assert all(r.case_id == f"c{r.event_id // 2}" and r.captures == 1 for r in got if r.kind == "capture")
    assert timers + more <= 8, "before: one for each opening"


def test_what_is_missing_stays_missing():
    pdf = pd.DataFrame({"ts_us": [1, 2], "n": [None, 3.0], "s": ["x", None], "skip": [1, 1]})
    assert in_order.Rows.of(pdf, ("ts_us", "n", "s")).rows == [(1, None, "x"), (2, 3.0, None)]
    assert in_order.Rows(("ts_us",), [(None,), (5_000_000,)]).pieces("ts_us", 1_000_000, 256)[0][:2] == (5, 5)
