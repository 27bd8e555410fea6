"""Filling fixed-capacity containers by lexical retrieval packing.

Texts are spread over shards of bounded size by a hash of their id.  In each shard
a BM25 inverted index is built; the largest unused text opens a container, its
nearest unused neighbours by BM25 fill it greedily, and what room is left goes to
the largest unused texts that still fit.

No text is split unless it alone exceeds the capacity: then every full piece is a
container of its own and the remainder is packed like any other text.  Null, empty
and blank texts of no tokens lie in their shard's first container.  All rows, also
repeated ones, come out once for each window.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import encoder, vocabulary

SCHEMA = "window_name string, container_id string, doc_id bigint, piece_no int, tokens int"
_WORD = re.compile(r"\w+")


class Bm25:
    """Inverted index of one shard; scores all its texts against one of them."""

    def __init__(self, texts: list[str], k1: float = 1.2, b: float = 0.75) -> None:
        ids: dict[str, int] = {}
        rows, terms, tfs = [], [], []
        for i, t in enumerate(texts):
            seen: dict[int, int] = {}
            for w in _WORD.findall(t.lower()):
                x = ids.setdefault(w, len(ids))
                seen[x] = seen.get(x, 0) + 1
            rows += [i] * len(seen)
            terms += seen.keys()
            tfs += seen.values()
        self.n = len(texts)
        row, term, tf = np.asarray(rows, np.int64), np.asarray(terms, np.int64), np.asarray(tfs, np.float64)
        length = np.bincount(row, tf, self.n)
        df = np.bincount(term, minlength=len(ids))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * length / max(length.mean(), 1e-9)) if self.n else length
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[row]) if len(row) else tf
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = row[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(df)))
        byrow = np.argsort(row, kind="stable")
        self.terms = term[byrow]
        self.row_start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.n))))

    def neighbours(self, i: int) -> np.ndarray:
        """Other texts with a term in common, best first (ties by position)."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in self.terms[self.row_start[i] : self.row_start[i + 1]]]
        if not spans:
            return np.empty(0, np.int64)
        s = np.bincount(np.concatenate([self.docs[x] for x in spans]), np.concatenate([self.weights[x] for x in spans]), self.n)
        s[i] = 0
        near = np.flatnonzero(s > 0)
        return near[np.argsort(-s[near], kind="stable")]


def pack_shard(sizes: list[int], capacity: int, near) -> list[tuple[int, int, int, int]]:
    """(item, piece, container, tokens) of one shard; ``near(i)`` gives an item's neighbours, best first."""
    out: list[tuple[int, int, int, int]] = []
    box = 0
    rest: dict[int, tuple[int, int]] = {}
    for i, n in enumerate(sizes):
        full = n // capacity if n > capacity else 0
        for p in range(full):
            out.append((i, p, box, capacity))
            box += 1
        left = n - full * capacity
        if left or not full:
            rest[i] = (full, left)
    queue = sorted((left, i) for i, (_, left) in rest.items())  # ascending; unused items
    first = box

    def take(left: int, i: int) -> None:
        del queue[bisect.bisect_left(queue, (left, i))]
        out.append((i, rest[i][0], box, left))
        del rest[i]

    while queue:
        if queue[-1][0] == 0 and box > first:
            break
        left, seed = queue[-1]
        take(left, seed)
        room = capacity - left
        if room >= (queue[0][0] if queue else capacity + 1):
            for j in near(seed):
                if room <= 0:
                    break
                j = int(j)
                if j in rest and 0 < rest[j][1] <= room:
                    room -= rest[j][1]
                    take(rest[j][1], j)
            while queue and room > 0:
                k = bisect.bisect_right(queue, (room, 1 << 62)) - 1
                if k < 0 or queue[k][0] == 0:
                    break
                room -= queue[k][0]
                take(*queue[k])
        box += 1
    for left, i in queue:  # no tokens: into the first container
        out.append((i, rest[i][0], first, left))
    return out


def pack(documents: DataFrame, windows: list[tuple[str, int]], shard_rows: int = 3000, path: str | None = None) -> DataFrame:
    """window_name, container_id, doc_id, piece_no, tokens of every text or piece for each window.

    ``windows`` holds a few (name, capacity) pairs.  ``shard_rows`` bounds the texts a task holds at
    a time; a row's number is hashed with it, so that repeated rows spread over the shards.
    """
    path = path or vocabulary()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    n = max(1, -(-docs.count() // shard_rows))
    good = [(str(w), int(c)) for w, c in windows if c is not None and int(c) > 0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = encoder(path)
        pdf = pdf.sort_values(["doc_id", "text"], na_position="first", kind="stable")
        texts = [t or "" for t in pdf["text"]]
        sizes = [e.count(t) for t in texts]
        ids = pdf["doc_id"].tolist()
        shard = int(pdf["shard"].iloc[0])
        index = Bm25(texts)
        found: dict[int, np.ndarray] = {}

        def near(i: int) -> np.ndarray:
            if i not in found:
                found[i] = index.neighbours(i).astype(np.int32)
            return found[i]

        rows = []
        for w, c in good:
            rows += [(w, f"{w}-{shard}-{box}", ids[i], p, k) for i, p, box, k in pack_shard(sizes, c, near)]
        return pd.DataFrame(rows, columns=["window_name", "container_id", "doc_id", "piece_no", "tokens"]).astype({"piece_no": "int32", "tokens": "int32"})

    shard = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return docs.withColumn("shard", shard).repartition(min(n, 4000), "shard").groupBy("shard").applyInPandas(run, SCHEMA)
