"""Byte-level BPE on ragged numpy arrays, and ids of whole texts.

``Merger`` counts tokens by rank-synchronous merging: the distinct pre-tokens of a batch lie in one
flat array of symbols with a start per sequence. In each round every sequence finds the pair of
lowest rank it holds and merges all its occurrences, all sequences at once; the symbols that
survive when no pair has a rank are the tokens.

Texts are split by the public pattern. Its character classes come from another Unicode table than
the tokenizer library's, so a text with a character beyond those on which both are known to agree is
split by the library itself. The string of the special token inside a text is that token.

Defined results: null is the empty text, with 0 tokens; repeated rows are counted alike; texts are
whole whatever their length (a long text is split in one pass, its distinct pre-tokens merged in
blocks); an empty table gives an empty result; all other input columns stay out of the Python step.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Any character outside of these ranges sends its text through the library's own splitter.
STRANGE = r"[^\x09-\x0d\x20-\x7e\xa1-ȳΑ-Ρα-ωА-я‐-‧‰-›€]"
CACHE = 1_000_000  # distinct pre-tokens a worker remembers before it starts afresh
BLOCK = 200_000  # pre-tokens merged at once


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        pair = left * self.size + right
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.path = path
        self.pattern, self.strange = regex.compile(PATTERN), regex.compile(STRANGE)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.library = None
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if not self.strange.search(text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special tokens stand in it."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text), 0
        pieces = self.cut.split(text)
        return [t for p in pieces for t in self.split(p)], len(pieces) - 1

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, starts) of byte sequences after all merges; starts has one entry more than there are sequences."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        none = len(self.merged)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), none)
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            low = np.repeat(least, np.diff(np.r_[starts, len(symbols)]))
            ended = low == none
            done_symbols.append(symbols[ended])
            done_owner.append(owner[ended])
            take = (rank == low) & ~ended
            # Of occurrences that overlap, every other one counted from the left merges.
            here = np.flatnonzero(take)
            if len(here):
                fresh = np.r_[True, np.diff(here) != 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
                here = here[(np.arange(len(here)) - run) % 2 == 0]
            symbols[here] = self.merged[rank[here]]
            keep = ~ended
            keep[here + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(sequences) + 1))

    def learn(self, tokens: Iterable[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        for i in range(0, len(new), BLOCK):
            block = new[i:i + BLOCK]
            _, starts = self.merge([t.encode() for t in block])
            self.known.update(zip(block, np.diff(starts).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        cut = [self.parts(t) for t in texts]
        self.learn({t for parts, _ in cut for t in parts})
        known = self.known.__getitem__
        return [sum(map(known, parts)) + extra for parts, extra in cut]


def blocks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` characters together, or one longer text."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > most:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs, vocabulary: str, limit: int = 512, key: str = "doc_id"):
    """(key, n_bytes, n_tokens, over_limit) of every row's whole ``text``; ``vocabulary`` is a file on every host."""

    def run(batches):
        merger = Merger(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks(texts):
                counts = merger.count(texts[i:j])
                sizes = [len(t.encode()) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([c > limit for c in counts])], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, "text").mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
