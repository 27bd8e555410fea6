"""Encoding of whole texts with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern; each distinct word of a
worker is encoded once.  A word's bytes are the leaves of a segment tree whose
nodes hold the leftmost pair of least rank; a merge updates the pairs of the two
live neighbours in O(log n) each, so a word of n bytes takes O(n log n) however long.

Encoding runs inside Arrow batches, without a shuffle.  Null and empty texts get an
empty list of ids; strings that spell special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"

# Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62


class _MinTree:
    """Segment tree over byte positions; a node holds ``rank << 32 | position`` of its least pair."""

    __slots__ = ("n", "t")

    def __init__(self, values: list[int]) -> None:
        n = 1
        while n < len(values):
            n *= 2
        self.n = n
        self.t = t = [_NONE] * n + values + [_NONE] * (n - len(values))
        for i in range(n - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a <= b else b

    def set(self, i: int, value: int) -> None:
        t = self.t
        i += self.n
        t[i] = value
        i >>= 1
        while i:
            a, b = t[2 * i], t[2 * i + 1]
            m = a if a <= b else b
            if t[i] == m:
                break
            t[i] = m
            i >>= 1


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: always the leftmost pair of least rank is merged."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    right = list(range(1, n + 1))  # end of the part that begins here
    left = list(range(-1, n - 1))  # begin of the part before

    def pair(i: int) -> int:
        j = right[i]
        if j >= n:
            return _NONE
        r = ranks.get(word[i : right[j]])
        return _NONE if r is None else r << 32 | i

    tree = _MinTree([pair(i) for i in range(n)])
    while tree.t[1] != _NONE:
        i = tree.t[1] & 0xFFFFFFFF
        j = right[i]
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        tree.set(j, _NONE)
        tree.set(i, pair(i))
        if left[i] >= 0:
            tree.set(left[i], pair(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : right[i]]])
        i = right[i]
    return out


class Encoder:
    """A vocabulary file with its word pattern; keeps the ids of up to ``keep`` distinct words."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(PATTERN).findall
        self.keep = keep
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                ids = encode_word(w.encode("utf-8", "surrogatepass"), self.ranks)
                if len(w) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[w] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(directory: str | None = None, file: str = DEFAULT_FILE) -> str:
    return os.path.join(directory or os.environ.get("TOKENIZER_DIR") or DEFAULT_DIR, file)


def token_ids(documents: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``documents`` with the ids of ``text`` as a list of integers in column ``out``."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for b in batches:
            yield b.map(e.encode)

    return documents.withColumn(out, ids(F.col(text)))


def token_counts(documents: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """``documents`` with the number of tokens of ``text`` in column ``out``."""
    path = path or vocabulary()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for b in batches:
            yield b.map(e.count)

    return documents.withColumn(out, count(F.col(text)))
