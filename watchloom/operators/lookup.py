"""Lookups of reference values, one-to-many collection, chained semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_or_default(df: DataFrame, ref: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``df`` with ``value`` of the reference row of its ``key``; the default where there is none.

    The planner broadcasts the reference side by its measured size; repeated keys keep the largest value.
    """
    r = ref.groupBy(key).agg(F.max(value).alias(value))
    return df.join(r, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def semi(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    return df.join(ref.select(key).distinct(), key, "left_semi")


def collect_per_key(rows: DataFrame, key: str, value: str, out: str, sep: str = "; ") -> DataFrame:
    """Sorted distinct values of each key as one text; keys own few values by nature (documents of a person)."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(out))
