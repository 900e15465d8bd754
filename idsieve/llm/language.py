"""Language identification by rank-order profiles of character n-grams.

The profile of a language is the list of its most frequent n-grams, in order of frequency. A document
gets the language for which its own most frequent n-grams are least out of place: the distance adds,
over the document's n-grams in order, how far each stands from its place in the profile, and the
profile's length where it has none. Ties go to the language first by name, n-grams of equal frequency
stand in order of their code points.

N-grams are of letters only, in lower case, with a mark at both ends of each run of letters.

Defined results: a null text, and one without any letter, is ``und`` with score 0; rows without a
language teach nothing; repeated rows are judged alike; with no labelled row at all every text is
``und``; texts are read whole; columns other than key and text take no part in a prediction.
The score is one minus the distance over the largest possible one.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.llm.tokens import blocks
from idsieve.operators.ordered import top_k_per_key

UNKNOWN = "und"
LETTERS = r"\p{L}+"
KEEP = 500_000  # n-grams a worker holds before it hands them on


@dataclass(frozen=True)
class Profiles:
    longest: int = 3  # at most 3
    ranks: int = 400

    def __post_init__(self):
        if not 1 <= self.longest <= 3 or self.ranks < 1:
            raise ValueError("n-grams have 1 to 3 characters, profiles at least one rank")


#: ASCII letters stay, as do all bytes beyond ASCII; the rest separates.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))
MANY = 40  # different characters beyond ASCII that are no letters, from which on a text is searched letter by letter


@cache
def foreign() -> re.Pattern:
    """Characters beyond ASCII that are no letters, as ``LETTERS`` has them."""
    every = "".join(map(chr, (*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1))))
    runs = [m.group() for m in regex.finditer(LETTERS, every)]
    # A run may go on behind the surrogates, which are no letters.
    parts = [p for r in runs for p in re.findall("[\x80-\ud7ff]+|[\ue000-\U0010ffff]+", r)]
    return re.compile("[^\x00-\x7f" + "".join(f"{p[0]}-{p[-1]}" for p in parts) + "]")


def runs(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    text = text.lower()
    if not text.isascii():
        strange = set(foreign().findall(text))
        if len(strange) > MANY:
            return regex.findall(LETTERS, text)
        for c in strange:
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split()


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


MARK = ord("_")
PART = (1 << 21) - 1


def gram_codes(words: list[str], longest: int) -> np.ndarray:
    """A number for every n-gram of some words, repeats included; numbers stand in order of the code points."""
    at = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    out = [at[at != MARK] << 42]
    if longest > 1:
        # Neighbours share a mark, so no two characters in a row belong to different words, but three may.
        pairs = at[:-1] << 42 | at[1:] << 21
        out.append(pairs)
        if longest > 2:
            out.append((pairs[:-1] | at[2:])[at[1:-1] != MARK])
    return np.concatenate(out)


def gram(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & PART, code & PART) if c)


def code(gram: str) -> int:
    """The number of an n-gram of up to three characters."""
    out = 0
    for i in range(3):
        out = out << 21 | (ord(gram[i]) if i < len(gram) else 0)
    return out


def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    total = np.zeros(len(codes), dtype=np.int64)
    np.add.at(total, back, np.concatenate([n for _, n in counts]))
    return codes, total


def learn(docs: DataFrame, how: Profiles = Profiles()) -> dict[str, list[str]]:
    """Profiles by language, from all rows of (text, lang) that have both; at most ``ranks`` n-grams a language come back."""
    longest = how.longest

    def run(batches):
        counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def hand_on():
            for lang, own in counts.items():
                codes, n = added(own)
                for i in range(0, len(codes), KEEP):
                    part = codes[i:i + KEEP]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([gram(c) for c in part.tolist()]), pa.array(n[i:i + KEEP])], ["lang", "gram", "n"])
            counts.clear()

        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in blocks(texts, 1_000_000):
                words: dict[str, list[str]] = {}
                for lang, text in zip(langs[i:j], texts[i:j], strict=True):
                    words.setdefault(lang, []).extend(runs(text))
                for lang, own in words.items():
                    if own:
                        found = np.unique(gram_codes(own, longest), return_counts=True)
                        counts.setdefault(lang, []).append(found)
                        held += len(found[0])
                if held > KEEP:
                    counts.update({lang: [added(own)] for lang, own in counts.items()})
                    held = sum(len(own[0][0]) for own in counts.values())
                    if held > KEEP // 2:
                        yield from hand_on()
                        held = 0
        yield from hand_on()

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = top_k_per_key(counts, ["lang"], [F.desc("n"), F.asc("gram")], how.ranks, salt_on=F.col("gram"))
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Judge:
    """Distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[str]], how: Profiles):
        self.how, self.langs = how, sorted(profiles)
        self.known = np.unique(np.array([code(g) for own in profiles.values() for g in own], dtype=np.int64))
        self.place = np.full((len(self.langs), len(self.known)), -1)
        for row, lang in zip(self.place, self.langs, strict=True):
            row[np.searchsorted(self.known, [code(g) for g in profiles[lang]])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = runs(text) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        codes, n = np.unique(gram_codes(found, self.how.longest), return_counts=True)
        if len(n) > self.how.ranks:
            # All that could stand among the first, with every n-gram that ties for the last place.
            least = np.partition(n, len(n) - self.how.ranks)[len(n) - self.how.ranks]
            codes, n = codes[n >= least], n[n >= least]
        codes = codes[np.argsort(-n, kind="stable")][:self.how.ranks]
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        places = np.where(self.known[at] == codes, self.place[:, at], -1)
        far = np.where(places < 0, self.how.ranks, np.minimum(np.abs(places - np.arange(len(codes))), self.how.ranks)).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (len(codes) * self.how.ranks)


def predict(docs: DataFrame, profiles: dict[str, list[str]], how: Profiles = Profiles(), key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row's whole ``text``."""

    def run(batches):
        judge = Judge(profiles, how)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks([t or "" for t in texts]):
                got = [judge(t) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                    ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
