"""Best representative of each duplicate group, chosen field by field.

The fields of every member are unpivoted to long rows, each row is graded, votes
(source trust times recency decay) are summed per normalised value, winners are
taken by ``max_by`` and pivoted back into one record a group.

The order of TESTDATA.md decides: completeness, trust, later listed_on, smaller
id; the votes are reported as the support of the winning value.  Every step is a
pre-aggregated hash aggregate, so a group holding a third of all rows costs no
single task its members.

Members listed twice count once; values that say nothing (null, blank, ``unknown``,
``-`` ...) never win, and a field all of whose values say nothing has no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import attributes as A

FIELDS = ("dob", "nationality", "identifiers", "designation")
_GRADED = T.StructType([T.StructField("grade", T.IntegerType()), T.StructField("norm", T.StringType())])


@F.pandas_udf(_GRADED)
def _grade(field: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Completeness (0: says nothing) and normalised form of one field's text."""
    grades, norms = [], []
    for f, v in zip(field, value):
        if f == "dob":
            d = A.dates(v)
            g, n = max((x[0] for x in d), default=0), "|".join(map(str, d))
        elif f == "nationality":
            c = A.countries(v)
            g, n = len(c), "|".join(c)
        elif f == "identifiers":
            x = A.numbers(v)
            g, n = len(x), "|".join(x)
        else:
            t = (v or "").strip()
            g, n = (0 if A.says_nothing(v) else len(t)), " ".join(t.lower().split())
        grades.append(g)
        norms.append(n)
    return pd.DataFrame({"grade": grades, "norm": norms})


def listed_date(c: Column) -> Column:
    """A listing date written in any of the lists' ways; null where it says nothing."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "d MMM yyyy", "d/M/yyyy", "d.M.yyyy", "MMM d, yyyy", "yyyy/M/d")]).cast("date")


def graded(groups: DataFrame, entities: DataFrame, sources: DataFrame, half_life_years: float = 10.0) -> DataFrame:
    """group_id, id, field, value, grade, norm, trust, listed, vote: one row a member and field that says something."""
    member = (
        entities.filter("id is not null")
        .groupBy("id")
        .agg(F.min(F.struct("source", "listed_on", *FIELDS)).alias("e"))
        .select("id", "e.*")
        .join(groups.select("id", "group_id"), "id")
        .join(sources.groupBy("source").agg(F.max("trust").alias("trust")), "source", "left")
        .withColumn("listed", listed_date(F.col("listed_on")))
    )
    long = member.select(
        "group_id", "id", F.coalesce("trust", F.lit(0)).alias("trust"), "listed",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x"),
    ).select("group_id", "id", "trust", "listed", "x.field", "x.value")
    age = F.coalesce(F.datediff(F.lit("2026-12-31"), F.col("listed")) / 365.25, F.lit(50.0))
    return (
        long.filter("value is not null and value <> ''")
        .withColumn("g", _grade("field", "value"))
        .select("*", "g.grade", "g.norm")
        .drop("g")
        .filter("grade > 0")
        .withColumn("vote", F.col("trust") * F.pow(F.lit(0.5), age / half_life_years))
    )


def _rank() -> Column:
    # strings can't be negated: the smaller id is settled by min_by over the inverse order instead
    return F.struct((-F.col("grade")).alias("g"), (-F.col("trust")).alias("t"), (-F.coalesce(F.unix_date("listed"), F.lit(-10_000_000))).alias("l"), F.col("id").alias("i"))


def winners(long: DataFrame) -> DataFrame:
    """group_id, field, id, value, support: the winning member of each field; support is its value's share of the votes."""
    votes = long.groupBy("group_id", "field", "norm").agg(F.sum("vote").alias("votes"), F.min_by(F.struct("id", "value"), _rank()).alias("who"), F.min(_rank()).alias("r"))
    return (
        votes.groupBy("group_id", "field")
        .agg(F.min_by(F.struct("who", "votes"), "r").alias("w"), F.sum("votes").alias("all"))
        .select("group_id", "field", F.col("w.who.id").alias("id"), F.col("w.who.value").alias("value"), F.round(F.when(F.col("all") > 0, F.col("w.votes") / F.col("all")).otherwise(F.lit(1.0)), 6).alias("support"))
    )


def golden_records(long: DataFrame) -> DataFrame:
    """One surviving record a group: the winning value of each field, its member and its support."""
    w = winners(long)
    aggs = []
    for f in FIELDS:
        hit = F.when(F.col("field") == f, F.struct("value", "id", "support"))
        aggs.append(F.max(hit).alias(f))
    g = w.groupBy("group_id").agg(*aggs)
    return g.select("group_id", *[x for f in FIELDS for x in (F.col(f"{f}.value").alias(f), F.col(f"{f}.id").alias(f"{f}_id"), F.col(f"{f}.support").alias(f"{f}_support"))])
