"""Only rows with copies are exchanged to find them; n-grams are counted as numbers."""

import random
import re
from collections import Counter

import pytest
import regex

from idsieve.llm import divergence, language, quality, shared


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_rows_by_copies(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "MARKS", most)
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), (None, "x", 4), (None, "x", 5), ("b", None, 6), ("a", "y z", 7)]
    once, others = shared.by_copies(spark.createDataFrame(rows, "lang string, text string, k int"), "lang", "text")
    assert others.columns == ["lang", "text", "k"]
    if most:
        assert sorted(r.k for r in once.collect()) == [3, 6, 7] and sorted(r.k for r in others.collect()) == [1, 2, 4, 5]
    else:
        assert once is None and others.count() == len(rows)


def test_texts_without_copies_are_not_grouped(spark, tmp_path):
    rows = [(k, f"word{k} " * 60, "en", "a") for k in range(40)] + [(90 + k, "copy " * 60, "en", "ab"[k % 2]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = _plan(divergence.collapsed(docs))
    assert "Union" in plan and "LeftAnti" in plan
    got = {r["text"]: {(c["source"], c["n"]) for c in r["copies"]} for r in divergence.collapsed(docs).collect()}
    assert len(got) == 41 and got["copy " * 60] == {("a", 3), ("b", 2)} and got["word7 " * 60] == {("a", 1)}
    found = {(r.source, r.term): (r.n, r.docs) for r in divergence.occurrences(divergence.collapsed(docs)).collect()}
    assert found["a", "copy"] == (180, 3) and found["b", "copy"] == (120, 2) and found["a", "word"] == (2400, 40)
    assert [r.texts for r in quality.fit_references(docs)] == [41]


def test_runs_of_letters_and_their_grams():
    rnd, find = random.Random(4), regex.compile(language.LETTERS).findall
    pool = [*"abC İßé_9²½ᲊǅʰ漢𝒜Ⅷ\x1c\x85\xa0\0", *(chr(c) for c in range(0x2000, 0x2080))]
    for most in (10, 25, len(pool)):
        for _ in range(300):
            text = "".join(rnd.choices(pool[:most], k=80))
            assert language.runs(text) == find(text.lower())
    assert not hasattr(language.Judge({"en": ["a"]}, language.Profiles()), "words")  # nothing is held a word
    for longest in (1, 2, 3):
        words = ["a", "bc", "漢字", "x", "def"]
        plain = Counter(g for w in words for n in range(1, longest + 1) for g in re.findall(f"(?=(.{{{n}}}))", f"_{w}_") if g != "_")
        codes = language.gram_codes(words, longest).tolist()
        assert Counter(map(language.gram, codes)) == plain and [language.code(language.gram(c)) for c in codes] == codes
        assert sorted(plain) == [language.gram(c) for c in sorted(set(codes))]


def test_profiles_do_not_depend_on_what_is_held(spark, monkeypatch):
    d = spark.createDataFrame([("the cat and the hat " * k, "en") for k in range(1, 9)] + [("der hut und die katze", "de"), ("1 2", "xx"), (None, "en")], "text string, lang string")
    whole = language.learn(d.coalesce(1))
    assert whole["en"][:2] == ["t", "a"] and set(whole) == {"en", "de"}
    monkeypatch.setattr(language, "KEEP", 5)
    assert language.learn(d.coalesce(1)) == whole
