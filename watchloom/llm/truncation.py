"""Text cut off by field limits or lost in transfer.

A backward character n-gram model is trained on all texts: for the last characters
of a text (contexts of several lengths) it compares the likelihood of standing at
the end of a text with that of going on.  Long contexts back off to shorter ones
and to the context's word shape.
Texts that look cut are taken out of the counts of ends, and the model is fitted again.  The log-odds are thresholded per language and
column: an EM step over their histogram gives each (source, language), and each
length that piles up there (a field limit), its share of cut texts, and with it the
threshold.  Unbalanced JSON, and half a character at the end (U+FFFD), count as cut
whatever stands before them.

Null, empty and blank texts are no cases.  Texts are processed whole; the model
holds counts only of contexts that end some text, by hash join, never on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Context lengths in characters; negative ones are taken over the word shape.
SIZES = (2, 4, -10, 7, 11, -18)
_LONGEST = 18
_MARK = re.compile(r"[\s​]*(?:�+|…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\))?[\s​]*$")
_DIGITS = str.maketrans("123456789", "000000000")
_CAPITAL = re.compile(r"[^\W\d_a-zа-яßà-öø-ÿ][\w'’]*")
_MUL = np.uint64(0x9E3779B97F4A7C15)


_STRAY = re.compile(r" ?[^\w\s.,;:!?'\"’()\[\]{}<>/\\@#$%&*+=|~^`…€£•–—-]+")
_BLANKS = re.compile(r"\s+")


def _body(t: str) -> str:
    """The text without blanks and marks of omission at its end; digits made equal, stray symbols dropped, blanks single."""
    return _BLANKS.sub(" ", _STRAY.sub("", _MARK.sub("", t))).rstrip().translate(_DIGITS)


def _shape(t: str) -> str:
    return _CAPITAL.sub("X", t)


def _grams(texts: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, 64-bit hashes of the n characters ending at each place, places where texts end), one size at a time.

    Texts stand in one array between runs of a filler, so that a context may begin with the start of its text.
    """
    gap = "\x00" * _LONGEST
    chars = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    chars += np.uint64(1)
    ends = np.cumsum(np.fromiter((len(t) + _LONGEST for t in texts), np.int64, len(texts))) - 1
    with np.errstate(over="ignore"):
        mult = _MUL
        h = chars * mult
        for k in range(2, max(sizes) + 1):
            mult = mult * _MUL * np.uint64(3) + np.uint64(1)
            h[k - 1 :] += chars[: len(chars) - k + 1] * mult
            if k in sizes:
                x = h >> np.uint64(31)
                x ^= h
                x *= np.uint64(0xD6E8FEB86659FD93)
                yield k, x, ends


def _hashes(bodies: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes at all places, hashes at the ends) for every size, in no order of SIZES."""
    for k, h, ends in _grams(bodies, [k for k in SIZES if k > 0]):
        yield k, h, h[ends]
    for k, h, ends in _grams([_shape(b) for b in bodies], [-k for k in SIZES if k < 0]):
        yield -k, h, h[ends]


#: Characters of text a task hashes at a time.
_BATCH = 3_000_000


def _broken_structure(t: str) -> bool:
    s = t.strip()
    if s.endswith("�"):
        return True
    if s[:1] not in "{[" or not re.match(r'[{\[]\s*["{\[\]}\d]', s) or re.match(r"\[\d+\] ", s):
        return False
    try:
        json.loads(s)
        return False
    except ValueError as e:
        return "Extra data" not in str(e)


_HS = [f"h{i}" for i in range(len(SIZES))]
_PASS = "k int, h bigint, n bigint, doc_id bigint, source string, lang string, len int, broken boolean, " + ", ".join(f"{h} bigint" for h in _HS)


def _one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the texts of a task, hashed once: occurrences of every context (k, h, n), aggregated before the shuffle, and a row a text with its final contexts."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        own = {c: [x for p in held for x in p[c].tolist()] for c in ("doc_id", "text", "source", "lang")}
        texts, final = own.pop("text"), {}
        for k, h, ends in _hashes([_body(t) for t in texts]):
            u, n = np.unique(h, return_counts=True)
            final[k] = ends.view(np.int64).copy()
            yield whole({"k": np.full(len(u), k, np.int32), "h": u.view(np.int64), "n": n}, len(u))
        own |= {"len": [len(t) for t in texts], "broken": [_broken_structure(t) for t in texts]} | {f"h{i}": final[k] for i, k in enumerate(SIZES)}
        yield whole({c: pd.Series(x, dtype=object) if c == "doc_id" else x for c, x in own.items()}, len(texts))

    def whole(given: dict, n: int) -> pd.DataFrame:
        return pd.DataFrame({c: given[c] if c in given else np.full(n, None, object) for c in columns})

    columns = [c.split()[0] for c in _PASS.split(", ")]
    for pdf in batches:
        held.append(pdf)
        size += int(pdf["text"].str.len().sum())
        if size > _BATCH:
            yield from flush()
            held.clear()
            size = 0
    if held and sum(map(len, held)):
        yield from flush()


def _blank() -> Column:
    return F.regexp_replace("text", r"[\p{Z}\p{Cc}\p{Cf}]+", "") == ""


def _fit_source(pdf: pd.DataFrame, surely: float) -> pd.DataFrame:
    """EM over one source's histogram: its rows with the decision on each (language, length, bin)."""
    n = pdf["n"].to_numpy(float)
    ratio = np.exp(np.clip(pdf["bin"].to_numpy(float) / 4.0, -30, 30))
    lang = pd.factorize(pdf["lang"])[0]
    length = pd.factorize(pdf["len"])[0]
    by_lang = np.bincount(lang, n)
    by_len = np.bincount(length, n)
    # a length counts as a possible field limit if it is far more frequent than its neighbours
    lens = np.zeros(len(by_len), np.int64)
    lens[length] = pdf["len"].to_numpy()
    order = np.argsort(lens)
    spread = by_len[order]
    near = np.array([np.median(spread[max(0, i - 10) : i + 11]) for i in range(len(spread))])
    piled = np.zeros(len(by_len), bool)
    piled[order] = (spread >= 8) & (spread > 5 * near + 3)
    overall = 0.05
    pi_lang = np.full(len(by_lang), overall)
    pi_len = np.where(piled, 0.5, overall)
    for _ in range(30):
        prior = np.where(piled[length], pi_len[length], pi_lang[lang])
        post = n * (prior / (prior + (1 - prior) * ratio))
        overall = min(0.5, max(1e-4, post.sum() / n.sum()))
        plain = ~piled[length]
        a = 50.0
        pi_lang = np.clip((np.bincount(lang, post * plain, len(by_lang)) + a * overall) / (np.bincount(lang, n * plain, len(by_lang)) + a), 1e-4, 0.5)
        pi_len = np.clip((np.bincount(length, post, len(by_len)) + 2 * 0.5) / (by_len + 2), 1e-4, 0.97)
    prior = np.where(piled[length], pi_len[length], pi_lang[lang])
    cut = (prior / (prior + (1 - prior) * ratio) > 0.5) | (pdf["bin"].to_numpy(float) / 4.0 < surely)
    return pd.DataFrame({"source": pdf["source"], "lang": pdf["lang"], "len": pdf["len"], "bin": pdf["bin"], "cut": cut})


def detect_truncated(documents: DataFrame, rounds: int = 3, expected: float = 0.08, surely: float = 1.0) -> DataFrame:
    """doc_id, source, ``log_odds`` of ending here and ``cut`` for every text that isn't blank.

    ``expected`` is the share of cut texts with which the fitting begins; below the log-odds ``surely`` a text is cut
    whatever the fitted threshold of its group.  Repeated rows keep their
    number.  A missing language, source or type is a group of its own; no texts give no rows.
    """
    docs = (
        documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"))
        .filter(F.col("text").isNotNull() & ~_blank())
    )
    hs = _HS
    read = materialize(docs.mapInPandas(_one_pass, _PASS))
    met = read.filter("k is not null").select("k", "h", "n")
    counts = met.groupBy("k", "h").agg(F.sum("n").alias("total"))
    ends = read.filter("k is null").drop("k", "h", "n")
    # texts share few distinct final contexts; scores are worked out once for each
    finals = ends.groupBy(*hs).agg(F.count("*").alias("n"))
    key = F.xxhash64(*hs).alias("final")
    long = finals.select(key, "n", F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(h).alias("h")) for k, h in zip(SIZES, hs)])).alias("at", "x")).select("final", "n", "at", "x.k", "x.h")
    contexts = long.select("k", "h").distinct().join(counts, ["k", "h"])
    long = materialize(long.join(contexts, ["k", "h"]))
    # the share of places where a text ends, over all texts
    base = met.filter(F.col("k") == SIZES[0]).agg(F.sum("n").alias("places")).first()["places"]
    n_texts = ends.count()
    prior = min(0.5, max(1, n_texts) / max(2, base or 2))
    ended = long.withColumn("own", F.lit(1.0))
    for _ in range(rounds):
        known = ended.groupBy("k", "h").agg(F.sum(F.col("n") * F.col("own")).alias("ended"))
        chain = ended.join(known, ["k", "h"]).groupBy("final").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("at", "total", "ended"))).alias("c"))
        p = F.aggregate("c", F.lit(prior), lambda acc, x: (F.greatest(x["ended"] - F.col("own"), F.lit(0.0)) + 3.0 * acc) / (F.greatest(x["total"] - 1, F.lit(0)) + 3.0))
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-6))
        odds = materialize(chain.select("final", (F.log(p / (1 - p)) - F.lit(np.log(prior / (1 - prior)).item())).alias("log_odds")))
        ended = long.join(odds.select("final", F.greatest(1 - F.lit(expected) * F.exp(-F.col("log_odds")), F.lit(0.0)).alias("own")), "final")
    texts = ends.withColumn("final", F.xxhash64(*hs)).join(odds, "final").withColumn("bin", F.floor(F.col("log_odds") * 4).cast("int"))
    histogram = texts.groupBy("source", "lang", "len", "bin").agg(F.count("*").alias("n"))
    decided = histogram.groupBy("source").applyInPandas(lambda p: _fit_source(p, surely), "source string, lang string, len int, bin int, cut boolean")
    return texts.join(decided, ["source", "lang", "len", "bin"]).select("doc_id", F.when(F.col("source") != "", F.col("source")).alias("source"), F.round("log_odds", 4).alias("log_odds"), (F.col("cut") | F.col("broken")).alias("cut"))


def truncation_rates(detected: DataFrame) -> DataFrame:
    """How often each source truncates: source, texts, cut_texts, share."""
    return detected.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts")).withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 6))
