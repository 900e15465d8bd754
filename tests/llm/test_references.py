"""References are fitted on all texts."""

import random

from idsieve.llm import quality


def test_references_take_all_texts(spark):
    rnd = random.Random(1)
    rows = [("en", " ".join(rnd.choice(["the", "The", "of", "A1"]) for _ in range(60)) + f" w{i}") for i in range(9_000)]
    rows += rows[:50] + [("en", "too short"), (None, "x " * 60), ("de", "Ä9 " * 60)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    by = {r.lang: r for r in quality.fit_references(d)}
    assert set(by) == {"en", "de"} and by["en"].texts == 9_000 and by["de"].texts == 1
    assert by["de"].chars == (0.0, 0.5, 0.5, 0.0, 0.0, 0.0) and by["de"].common == (("ä9", 1.0),)
    words = [w.lower() for _, t in rows[:9_000] for w in t.split()]
    assert dict(by["en"].common)["the"] == words.count("the") / len(words)
