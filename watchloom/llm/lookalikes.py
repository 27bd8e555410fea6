"""Visually identical text with different characters, brought to one consistent form.

1. Statistics: how often each code point occurs over the whole text columns, one
   pre-aggregated count in Spark.  The number of distinct code points is bounded by
   the size of Unicode, so that table (never the texts) comes to the driver.
2. Classes: union-find joins strings and code points that look alike: compatibility
   and canonical (de)compositions, letters drawn alike in other scripts, spaces,
   hyphens, and invisible characters (alike to the empty string).  Classes are
   transitive: a full-width Cyrillic-like letter and its plain form meet in one class.
3. Representative: the member that is most frequent in the corpus among those in
   normal form (NFKC), the empty string for invisible characters.
4. Rewriting: an Aho-Corasick automaton over all members rewrites each text from
   the left, longest match first, inside Arrow batches.

Letters of another script are rewritten only where they pose as the script around
them: a token of mixed scripts, or one made of look-alikes only between tokens of
that script.  A name wholly in another script stays as it is, also beside its Latin form.

Null gives null, empty text gives empty text; every text is processed whole, and
rewriting a consistent text changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import LOOKALIKES, _script

# Characters drawn as a hyphen.
_HYPHENS = "‐‑‒–−﹣－⁃˗"


def invisible(c: str) -> bool:
    """Characters that draw nothing: format characters, joiners, fillers, selectors."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def char_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Occurrences of each code point outside ASCII, and of ASCII ones, over whole columns."""
    texts = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("t")).filter("t is not null")
    chars = texts.select(F.explode(F.split("t", "")).alias("ch")).filter("ch <> ''")
    return {r["ch"]: r["n"] for r in chars.groupBy("ch").agg(F.count("*").alias("n")).toLocalIterator()}


def build_classes(counts: dict[str, int]) -> tuple[dict[str, str], dict[str, str]]:
    """(always, posing): member to representative, for rewrites that hold anywhere, and for
    look-alikes of other scripts, which hold only where a letter poses as its neighbours' script."""
    uf = UnionFind()
    seen: set[str] = set()
    for ch in counts:
        if ord(ch) < 128:
            continue
        seen.add(ch)
        if invisible(ch):
            uf.union(ch, "")
            continue
        if unicodedata.category(ch) == "Zs":
            uf.union(ch, " ")
        elif ch in _HYPHENS:
            uf.union(ch, "-")
        for form in (unicodedata.normalize("NFKC", ch), unicodedata.normalize("NFD", ch)):
            form = "".join(" " if unicodedata.category(x) == "Zs" else x for x in form)
            if form != ch:
                uf.union(ch, form)
                seen.add(form)
    for other, plain in LOOKALIKES.items():
        if other in counts:
            uf.union(other, plain)
            seen |= {other, plain}
    members: dict[str, list[str]] = {}
    for m in [*seen, " ", "-", ""]:
        members.setdefault(uf.find(m), []).append(m)

    def weight(m: str) -> int:
        return min(counts.get(c, 0) for c in m) if m else 0

    always: dict[str, str] = {}
    posing: dict[str, str] = {}
    for group in members.values():
        if len(group) < 2:
            continue
        if "" in group:
            rep = ""
        else:
            normal = [m for m in group if unicodedata.normalize("NFKC", m) == m and m not in LOOKALIKES and not (len(m) == 1 and m in _HYPHENS)]
            rep = " " if " " in group else "-" if "-" in group else max(normal or group, key=lambda m: (weight(m), -len(m), m))
        for m in group:
            if m != rep:
                if m in LOOKALIKES:
                    posing[m] = LOOKALIKES[m]
                else:
                    always[m] = unicodedata.normalize("NFC", rep)
    return always, posing


_TOKEN = re.compile(r"[^\s\-'’()\[\],.|/]+")


class Rewriter:
    """Greedy leftmost-longest rewriting with an Aho-Corasick automaton."""

    def __init__(self, always: dict[str, str], posing: dict[str, str]) -> None:
        import ahocorasick

        self.posing = posing
        self.reverse_of: dict[str, dict[str, str]] = {"C": {}, "G": {}}
        for other, plain in LOOKALIKES.items():
            if _script(other) in self.reverse_of:
                self.reverse_of[_script(other)].setdefault(plain, other)
        self.reverse = {x for m in self.reverse_of.values() for x in m}
        self.auto = ahocorasick.Automaton()
        for k, v in always.items():
            self.auto.add_word(k, (len(k), v))
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()

    def _greedy(self, s: str) -> str:
        if not self.some:
            return s
        best: dict[int, tuple[int, str]] = {}
        for end, (n, v) in self.auto.iter(s):
            start = end - n + 1
            if start not in best or best[start][0] < n:
                best[start] = (n, v)
        if not best:
            return s
        out, i = [], 0
        for start in sorted(best):
            if start < i:
                continue
            n, v = best[start]
            out += (s[i:start], v)
            i = start + n
        return "".join(out) + s[i:]

    def __call__(self, s: str) -> str:
        if s.isascii():
            return s
        s = unicodedata.normalize("NFC", self._greedy(s))
        if s.isascii() or not any(_script(c) not in ("", "L") or c in self.posing for c in s):
            return s
        spans = [(m.start(), m.end(), {_script(c) for c in m.group()} - {""}) for m in _TOKEN.finditer(s)]
        latin_around = any(k == {"L"} and b - a > 1 for a, b, k in spans)
        native = {x for a, b, k in spans if "L" not in k and any(_script(c) in k and c not in self.posing for c in s[a:b]) for x in k}
        out = list(s)
        for a, b, k in spans:
            if not k - {"L"}:
                # ɑ and ɡ are Latin letters that pose as plain ones
                for i in range(a, b):
                    if 0x250 <= ord(out[i]) and out[i] in self.posing:
                        out[i] = self.posing[out[i]]
                continue
            mixed = "L" in k
            whole = not mixed and latin_around and not (k & native) and all(c in self.posing or not c.isalpha() for c in s[a:b])
            own = [c for c in s[a:b] if _script(c) in ("C", "G") and c not in self.posing]
            plain = sum(_script(c) == "L" and c not in self.reverse for c in s[a:b])
            if mixed and len(own) > plain:  # Latin letters pose in a word of another script
                back = self.reverse_of[_script(own[0])]
                for i in range(a, b):
                    if _script(out[i]) == "L":
                        out[i] = back.get(out[i], out[i])
            elif mixed or whole:
                for i in range(a, b):
                    out[i] = self.posing.get(out[i], out[i])
        return "".join(out)


def consistent_form(df: DataFrame, columns: list[str], suffix: str = "_consistent") -> DataFrame:
    """``df`` with the consistent form of each of ``columns`` beside it (``<column><suffix>``)."""
    always, posing = build_classes(char_counts(df, columns))

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Rewriter(always, posing)
        for b in batches:
            yield b.map(lambda t: None if t is None else r(t))

    return df.select("*", *[rewrite(F.col(c)).alias(c + suffix) for c in columns])
