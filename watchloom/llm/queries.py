"""The package's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import components, entity_match, lookalikes, name_variants, packing, survivors, tokenizer, truncation


def _matches(s: SparkSession, d: str) -> DataFrame:
    return entity_match.match_entities(table(s, d, "sanctions_entities"), table(s, d, "pair_labels"))


def p1_matches(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score", "confidence")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    decided = table(s, d, "match_pairs").select(F.explode(F.array("id_a", "id_b")).alias("k")).filter("k is not null").distinct()
    found = entity_match.same_person(_matches(s, d)).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return found.join(decided, F.col("id_a") == F.col("k"), "left_anti").join(decided, F.col("id_b") == F.col("k"), "left_anti")


def _groups(s: SparkSession, d: str) -> DataFrame:
    return components.components(components.merged_edges(table(s, d, "match_pairs"), table(s, d, "sanctions_entities")))


def _graded(s: SparkSession, d: str) -> DataFrame:
    return survivors.graded(_groups(s, d), table(s, d, "sanctions_entities"), table(s, d, "list_sources"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return survivors.winners(_graded(s, d)).select("group_id", "field", "id")


def p2_golden(s: SparkSession, d: str) -> DataFrame:
    return survivors.golden_records(_graded(s, d))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _groups(s, d)


def _links(s: SparkSession, d: str) -> DataFrame:
    return name_variants.link_screenings(table(s, d, "screenings"), table(s, d, "sanctions_entities"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return _links(s, d).select("screening_id", "entity_id")


def p4_stars(s: SparkSession, d: str) -> DataFrame:
    """How many screenings and entries each star of spellings holds."""
    return _links(s, d).groupBy("star").agg(F.count_distinct("screening_id").alias("screenings"), F.count_distinct("entity_id").alias("entries"))


P5_FIELDS = ["name", "name_latin", "name_ascii"]


def p5_forms(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "sanctions_entities").filter("id is not null").select("id", *P5_FIELDS).distinct()
    return lookalikes.consistent_form(e, P5_FIELDS)


def p5_found(s: SparkSession, d: str) -> DataFrame:
    f = p5_forms(s, d)
    changed = F.array_compact(F.array(*[F.when(F.col(c) != F.col(c + "_consistent"), F.lit(c)) for c in P5_FIELDS]))
    return f.select("id", F.explode(changed).alias("field")).distinct()


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_packed(s: SparkSession, d: str) -> DataFrame:
    windows = [(r["window_name"], r["capacity_tokens"]) for r in table(s, d, "pack_windows").collect()]  # a fixed table of a few rows
    return packing.pack(table(s, d, "documents"), windows)


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return truncation.detect_truncated(table(s, d, "documents")).filter("cut").select("doc_id").distinct()


def p9_rates(s: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.detect_truncated(table(s, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(s: SparkSession, d: str) -> DataFrame:
            ship(s)
            return f(s, d)

        return run

    fs = (p1_found, p1_matches, p2_found, p2_golden, p3_found, p4_found, p4_stars, p5_found, p5_forms, p7_ids, p8_packed, p9_found, p9_rates)
    return {f.__name__: shipped(f) for f in fs}


_P3 = """
WITH RECURSIVE listed AS (SELECT DISTINCT id FROM sanctions_entities WHERE id IS NOT NULL),
latest AS (
  SELECT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b, merged,
         row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b) ORDER BY decided_at DESC NULLS LAST, merged DESC) AS rn
  FROM match_pairs WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND id_a <> id_b AND merged IS NOT NULL),
edges AS (SELECT a, b FROM latest WHERE rn = 1 AND merged AND a IN (SELECT id FROM listed) AND b IN (SELECT id FROM listed)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id)
SELECT id, min(root) AS group_id FROM reach GROUP BY id
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3}
