"""Consolidating pairwise matches into groups by low-diameter decomposition.

Each level lets clusters grow from every vertex, with start times shifted by an
exponential draw, for a few rounds; every vertex joins the centre that reaches it
first.  Clusters are contracted to super-vertices and the level is repeated on the
edges between clusters until none is left; the assignments are composed.

A round costs one join and one pre-aggregated minimum, both keyed by vertex.  The
number of vertices falls by a constant factor a level, so a chain of n vertices
takes O(log n) levels, not O(n) rounds.  Stopping the growth after a fixed number
of rounds never breaks a group: a vertex and its centre are always connected, and
every edge is carried over to the labels of its ends.

Edges: nulls, blank ids and self-pairs are dropped, repeated pairs count once;
an empty edge table gives an empty result.  Group ids are the smallest member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def merged_edges(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """a, b: pairs whose latest decision, in either order, is to merge, both ids being listed.

    Equal times: a decision to merge holds.  Missing times come first, a missing decision is none.
    """
    ids = entities.select(F.col("id").alias("k")).filter("k is not null").distinct()
    last = (
        pairs.filter("id_a is not null and id_b is not null and id_a <> id_b and merged is not null")
        .groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .agg(F.max(F.struct("decided_at", "merged")).alias("last"))
        .filter("last.merged")
        .select("a", "b")
    )
    return last.join(ids, F.col("a") == F.col("k"), "left_semi").join(ids, F.col("b") == F.col("k"), "left_semi")


def _clusters(edges: DataFrame, level: int, beta: float, rounds: int) -> DataFrame:
    """v, c: each vertex with the centre that reaches it first within ``rounds`` steps."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))).alias("x")).select("x.v", "x.to")
    # with a step of no cost to itself a vertex keeps its value, and a round reads the last one only once
    steps = materialize(ends.withColumn("cost", F.lit(1.0)).unionAll(ends.select("v", F.col("v").alias("to"), F.lit(0.0).alias("cost")).distinct()))
    unit = (F.pmod(F.xxhash64(F.col("v"), F.lit(level)), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    state = steps.filter("cost = 0").select("v", F.struct((F.log(unit) / beta).alias("at"), F.col("v").alias("c")).alias("s"))
    for _ in range(rounds):
        reached = steps.join(state, "v").select(F.col("to").alias("v"), F.struct((F.col("s.at") + F.col("cost")).alias("at"), F.col("s.c").alias("c")).alias("s"))
        state = reached.groupBy("v").agg(F.min("s").alias("s"))
    return state.select("v", F.col("s.c").alias("c"))


def components(edges: DataFrame, beta: float = 0.35, rounds: int = 4, max_levels: int = 64) -> DataFrame:
    """id, group_id for every vertex of ``edges`` (a, b); group_id is the smallest id of its group.

    ``beta`` is the rate of the start shifts (smaller: larger clusters, fewer levels) and
    ``rounds`` the growth steps of a level.  Only a row count returns to the driver each level.
    """
    edges = materialize(
        edges.filter("a is not null and b is not null and a <> '' and b <> '' and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    assigned: DataFrame | None = None
    for level in range(max_levels):
        clusters = materialize(_clusters(edges, level, beta, rounds))
        if assigned is None:
            assigned = clusters.select(F.col("v").alias("id"), F.col("c").alias("label"))
        else:
            m = clusters.select(F.col("v").alias("label"), "c")
            assigned = materialize(assigned.join(m, "label", "left").select("id", F.coalesce("c", "label").alias("label")))
        ca, cb = clusters.select(F.col("v").alias("a"), F.col("c").alias("ca")), clusters.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        edges = materialize(
            edges.join(ca, "a").join(cb, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        )
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components: edges between clusters are left after the last level")
    least = assigned.groupBy("label").agg(F.min("id").alias("group_id"))
    return assigned.join(least, "label").select("id", "group_id")
