"""Normalised profiles of watchlist entries and of typed subjects, computed in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attributes as A
from . import names as N

PROFILE = "names array<string>, dobs array<array<int>>, vague boolean, nats array<string>, nums array<string>, gender string"


def _gender(x: str | None) -> str:
    t = (x or "").strip().lower()[:1]
    return t if t in ("m", "f") else ""


def spellings(*fields: str | None) -> list[str]:
    """Distinct normalised names (tokens joined by a blank) of ``|`` lists, in order."""
    out: list[str] = []
    for f in fields:
        for x in (f or "").split("|"):
            t = " ".join(N.tokens(x))
            if t and t not in out:
                out.append(t)
    return out


def entity_profiles(entities: DataFrame) -> DataFrame:
    """id, source and profile of every entry; exact repetitions of an id count once, rows without id are ignored."""
    cols = ["source", "name", "name_latin", "aliases", "dob", "nationality", "identifiers", "gender"]
    rows = entities.filter("id is not null").groupBy("id").agg(F.min(F.struct(*cols)).alias("e")).select("id", "e.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "id": b["id"], "source": b["source"].fillna(""),
                "names": [spellings(n, a) or spellings(lat) for n, lat, a in zip(b["name"], b["name_latin"], b["aliases"])],
                "dobs": [[list(x) for x in A.dates(d)] for d in b["dob"]],
                "vague": [A.vague(d) for d in b["dob"]],
                "nats": [A.countries(x) for x in b["nationality"]],
                "nums": [A.numbers(x) for x in b["identifiers"]],
                "gender": [_gender(g) for g in b["gender"]],
            })

    return rows.mapInPandas(run, "id string, source string, " + PROFILE)


def read_input(text: str | None) -> dict[str, str]:
    """The text fields of a subject's JSON object; anything else counts as absent."""
    try:
        d = json.loads(text or "")
    except ValueError:
        return {}
    return {k: v for k, v in d.items() if isinstance(v, str)} if isinstance(d, dict) else {}


def subject_numbers(d: dict[str, str]) -> list[str]:
    got = {(k, A.number(d.get(f) or "")) for f, k in (("passport", "p"), ("cnic", "n"))}
    return sorted(f"{k}:{v}" for k, v in got if v)
