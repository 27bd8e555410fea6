"""Connected components by alternating large-star and small-star steps over checked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _digest(e: DataFrame) -> tuple:
    """Count and two hash sums of an edge table: equal tables have equal ones, and a changed table by a chance of 2^-64 only."""
    h = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return tuple(e.agg(F.count("*"), h("u", "v"), h("v", F.lit(1), "u")).first())


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """id, component (the smallest id) for every vertex of ``edges`` (a, b); O(log n) rounds in practice, an error after ``max_rounds``."""
    e = materialize(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _digest(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        nxt = materialize(small.filter("u <> v").distinct())
        e, last, seen = nxt, seen, _digest(nxt)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select("u", F.col("v").alias("component")).groupBy("u").agg(F.min("component").alias("component"))
    every = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    return every.join(roots, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))
