"""Pages: what is stored on the way is hashes of lines, not their text."""

import os
import random

from idsieve.llm import pages


def test_no_text_is_stored(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("idsieve.llm.shared.base_folder", lambda _: str(tmp_path))
    rnd = random.Random(7)
    own = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=4_000)).strip() for _ in range(3)] for _ in range(60)]
    html = "<p>Top of the site</p>{}<p>Foot of the site</p>"
    rows = [(i, f"http://h/{i % 50:02}", html.format("".join(f"<p>{x}</p>" for x in own[i % 50]))) for i in range(60)] + [(99, None, None)]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    stored = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert 0 < stored < 200_000 < 0.4 * sum(len(h or "") for *_, h in rows)
    assert {r.page_id: r.text for r in found.collect()} == {
        **{i: "\n\n".join(" ".join(x.split()) for x in own[i % 50]) for i in range(60)}, 99: ""}
