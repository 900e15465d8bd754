"""Several sinks of a stream under one list of finished batches: repeats, half-written batches, going on."""

import pytest
from pyspark.sql import functions as F

from idsieve.operators import audit as oa, cases as oc, hash_tree as ht
from idsieve.streaming import screen as sc

DOCS = "doc_id long, submitted_at timestamp, n long"


def screen(batch):
    return batch.select("doc_id", F.when(F.col("n") > 5, "PASS").otherwise("INCONCLUSIVE").alias("decision"), F.lit("PASSPORT").alias("document_type"),
                        (F.col("n") / 10).alias("confidence"))


def docs(spark, ids, n=3):
    return spark.createDataFrame([(i, 1_700_000_000 + i, n) for i in ids], "doc_id long, t long, n long").select("doc_id", F.timestamp_seconds("t").alias("submitted_at"), "n")


def state(spark, path):
    cases = {r.doc_id: (r.case_id, r.decision) for r in oc_latest(sc.read_sink(spark, path, "cases", sc.CASES)).collect()}
    events = sc.read_sink(spark, path, "audit", sc.EVENTS)
    return cases, events


def oc_latest(rows):
    from idsieve.operators.ordered import last_per_key

    return last_per_key(rows, ["doc_id"], F.col("batch"))


def run(spark, path, frame, batch_id):
    sc.take_batch(frame, batch_id, path, screen)


def test_batches_go_on_and_repeats_add_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    run(spark, path, docs(spark, range(0, 6)), 0)
    run(spark, path, docs(spark, range(4, 9), n=8), 1)
    cases, events = state(spark, path)
    assert [cases[i][0] for i in range(9)] == [f"DS-2023-{i + 1:06d}" for i in range(9)]
    assert cases[5][1] == "PASS" and cases[0][1] == "INCONCLUSIVE" and events.count() == 11
    before = sorted(map(str, events.collect()))
    run(spark, path, docs(spark, range(4, 9), n=8), 1)
    assert sorted(map(str, state(spark, path)[1].collect())) == before
    assert {(r.chain_status, r.checked) for r in oa.verify(events.drop("batch")).collect()} == {("VALID", 1), ("VALID", 2)}
    tips = {r.case_id: r.tip for r in oc_tips(spark, path).collect()}
    assert tips == {r.case_id: r.tip for r in ht.leaves(events).collect()}


def oc_tips(spark, path):
    from idsieve.operators.ordered import last_per_key

    return last_per_key(sc.read_sink(spark, path, "tips", sc.TIPS), ["case_id"], F.col("batch"))


def test_a_batch_that_stops_halfway_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    run(spark, path, docs(spark, range(3)), 0)
    monkeypatch.setattr(sc, "write_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sc.write_batch(spark, path, 1, sc.screen_batch(docs(spark, range(3, 6)), 1, path, screen))
    monkeypatch.undo()
    cases, events = state(spark, path)
    assert set(cases) == {0, 1, 2} and events.count() == 3 and sc.finished(spark, path) == [0]
    run(spark, path, docs(spark, range(3, 6)), 1)
    cases, events = state(spark, path)
    assert sorted(c for c, _ in cases.values()) == [f"DS-2023-{i:06d}" for i in range(1, 7)] and events.count() == 6


def test_nothing_yet(spark, tmp_path):
    assert sc.finished(spark, str(tmp_path / "no")) == [] and sc.read_sink(spark, str(tmp_path / "no"), "cases", sc.CASES).count() == 0


def test_as_a_stream_with_a_restart(spark, tmp_path):
    path, feed = str(tmp_path / "s"), str(tmp_path / "in")
    for part, more in ((range(0, 4), range(4, 8)), (range(8, 12), [])):
        for ids in (part, more):
            if ids:
                docs(spark, ids).coalesce(1).write.mode("append").parquet(feed)
        source = spark.readStream.schema(docs(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(feed)
        sc.screen_to_sinks(source, screen, path, str(tmp_path / "cp")).awaitTermination()
    cases, events = state(spark, path)
    assert sorted(c for c, _ in cases.values()) == [f"DS-2023-{i:06d}" for i in range(1, 13)] and sc.finished(spark, path) == [0, 1, 2]
    assert oc.CASE_PREFIX == "DS" and events.count() == 12
