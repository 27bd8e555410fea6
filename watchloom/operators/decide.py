"""Decisions that come from outside the plan: parsing with safe defaults, guards, overrides, batching."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wording in a clearing verdict that asks for more review.
DOUBT = (
    "escalate", "escalation", "human review", "manual review", "warrants review", "needs review", "should be reviewed", "cannot confidently clear",
    "cannot be confidently cleared", "insufficient to clear", "unable to clear", "warrants further",
)
# Sources of sanctions and wanted lists.
HARD_LISTS = ("ofac_sdn", "ofac_cons", "un_consolidated", "eu_fsf", "uk_sanctions", "ca_sema", "ch_seco", "australia_dfat", "fbi_wanted")
VERDICTS = ("CLEARED", "LIKELY_MATCH", "ESCALATE")
DECISION = "match_number int, verdict string, reasoning string"


class Classifier(Protocol):
    """Answers a batch of matches with text that should hold a JSON array of decisions."""

    def __call__(self, rows: list[dict]) -> str: ...


def escalate_everything(rows: list[dict]) -> str:
    return json.dumps([{"match_number": r["match_number"], "verdict": "ESCALATE", "reasoning": "no classifier"} for r in rows])


_FENCE = re.compile(r"^```[^\n]*\n|\n?```\s*$")


def read_decisions(answer: str, numbers: list[int]) -> list[tuple[int, str, str]]:
    """Decisions of an answer; anything missing, unknown or unreadable is ESCALATE."""
    got: dict[int, tuple[str, str]] = {}
    try:
        body = _FENCE.sub("", answer.strip())
        found = re.search(r"\[.*\]", body, re.S)
        for d in json.loads(found.group(0) if found else body):
            v = str(d.get("verdict", "")).upper()
            got[int(d.get("match_number", 0))] = (v if v in VERDICTS else "ESCALATE", str(d.get("reasoning", "")))
    except (ValueError, AttributeError, TypeError):
        got = {}
    return [(n, *got.get(n, ("ESCALATE", "no readable decision"))) for n in numbers]


def classify(matches: DataFrame, classifier: Callable[[list[dict]], str] = escalate_everything, batch: int = 25) -> DataFrame:
    """screening_id, match_number, verdict, reasoning; one call for each ``batch`` matches of a screening.

    A failing call escalates its batch.  Materialise the result: a retry would call again.
    """
    numbered = matches.withColumn("batch_no", batch_number(F.col("match_number"), batch))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("match_number").to_dict("records")
        nums = [int(r["match_number"]) for r in rows]
        try:
            answer = classifier(rows)
        except Exception:  # noqa: BLE001 - any failure must escalate
            answer = ""
        out = pd.DataFrame(read_decisions(answer, nums), columns=["match_number", "verdict", "reasoning"])
        out.insert(0, "screening_id", rows[0]["screening_id"])
        return out

    return numbered.groupBy("screening_id", "batch_no").applyInPandas(run, "screening_id string, " + DECISION)


def batch_number(n: Column, size: int = 25) -> Column:
    return F.floor((n - 1) / size).cast("int")


def doubt_in(reasoning: Column) -> Column:
    """The first of the fixed wordings of doubt that a text holds; null if none."""
    low = F.lower(F.coalesce(reasoning, F.lit("")))
    return F.get(F.filter(F.array(*[F.lit(p) for p in DOUBT]), lambda p: F.contains(low, p)), 0)


def doubt_guard(verdict: Column, reasoning: Column) -> Column:
    """ESCALATE where a clearing verdict's own reasoning voices doubt."""
    return F.when((verdict == "CLEARED") & doubt_in(reasoning).isNotNull(), "ESCALATE").otherwise(verdict)


def doubted_reason(verdict: Column, reasoning: Column) -> Column:
    """The reasoning, headed by the wording for which ``doubt_guard`` escalates it."""
    hit = doubt_in(reasoning)
    return F.when((verdict == "CLEARED") & hit.isNotNull(), F.concat(F.lit("[cleared in doubt: "), hit, F.lit("] "), reasoning)).otherwise(reasoning)


def no_data_guard(verdict: Column, sources: Column, dobs: Column, nats: Column, values: Column) -> Column:
    """ESCALATE where a clearing verdict concerns a hard list's entry with nothing to verify against."""
    bare = (F.size(dobs) <= 0) & (F.size(nats) <= 0) & (F.size(F.filter(values, lambda v: v != "")) <= 0)
    return F.when((verdict == "CLEARED") & F.arrays_overlap(sources, F.array(*[F.lit(s) for s in HARD_LISTS])) & bare, "ESCALATE").otherwise(verdict)


def override(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Decisions of a first pass, replaced where a second pass has one."""
    s = second.select(*key, F.col("verdict").alias("_v"), F.col("reasoning").alias("_r"))
    return first.join(s, key, "left").withColumn("verdict", F.coalesce("_v", "verdict")).withColumn("reasoning", F.coalesce("_r", "reasoning")).drop("_v", "_r")


def numbered(df: DataFrame, within: str, order: list[str]) -> DataFrame:
    return df.withColumn("match_number", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def research(escalated: DataFrame, ask: Callable[[dict], str]) -> DataFrame:
    """screening_id, match_number, verdict, reasoning of a second pass over single matches; failures escalate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                try:
                    found = re.search(r"\{.*\}", ask(r), re.S)
                    d = json.loads(found.group(0)) if found else {}
                except Exception:  # noqa: BLE001
                    d = {}
                v = str(d.get("decision", "")).upper()
                rows.append((r["screening_id"], int(r["match_number"]), v if v in VERDICTS else "ESCALATE", str(d.get("reasoning", ""))))
            yield pd.DataFrame(rows, columns=["screening_id", "match_number", "verdict", "reasoning"])

    schema = T.StructType([T.StructField("screening_id", T.StringType()), T.StructField("match_number", T.IntegerType()), T.StructField("verdict", T.StringType()), T.StructField("reasoning", T.StringType())])
    return escalated.mapInPandas(run, schema)
