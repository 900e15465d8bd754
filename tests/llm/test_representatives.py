"""The pipeline groups documents by fingerprints."""

import corpus_pipeline
from idsieve.llm import simhash


def test_pipeline_groups_by_fingerprints(spark):
    same = "alpha beta gamma " * 60
    texts = {k: same + " ".join(f"u{k}x{j}" for j in range(30)) for k in (5, 3, 9)}
    lone = {k: " ".join(f"v{k}x{j}" for j in range(80)) for k in (1, 4)}
    rows = [*texts.items(), *lone.items(), (4, lone[4]), (1, texts[3]), (None, lone[1] + " more words here"), (None, texts[9])]
    d = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, key string")
    assert len({tuple(simhash.fingerprint(t)) for t in texts.values()}) == 1
    kept = corpus_pipeline.near_duplicates(spark, d, "")
    assert kept.columns == d.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    # Row 1 holds a copy as well as a text of its own: the group's least key is 1, and of the rows of a key one stays in each group.
    assert [g for g, _ in got if g == "4"] == ["4"] and not {"3", "5", "9"} & {g for g, _ in got}
    assert simhash.representatives(d.filter("false")).count() == 0
