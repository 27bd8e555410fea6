"""Registered queries over the test tables, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, similarity, text
from ..operators import decide, lookup, report, resolve, retrieval, rules, store
from ..operators.components import connected_components
from ..operators.snapshot_diff import diff_snapshots
from ..session import ship, table
from .screening import phonetic_rows, query_rows, screen, subjects_of

Query = Callable[[SparkSession, str], DataFrame]


def _entities(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Columns of the entity table (all if none are named), one row an id: rows of one id are exact repetitions, so what is left out can't tell them apart."""
    e = table(s, d, "sanctions_entities").filter("id is not null")
    return (e.select("id", *[c for c in cols if c != "id"]) if cols else e).distinct()


def scan_filter_project(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sanctions_entities").filter(F.col("source").isin("wikidata_peps", "us_congress", "uk_parliament", "eu_parliament")).select("id", "source", "name", "designation")


def point_lookup(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "screenings")
    first = t.agg(F.min("id").alias("id"))
    return t.join(first, "id", "left_semi").select("id", "result", "processing_ms").distinct()


def upsert_last_wins(s: SparkSession, d: str) -> DataFrame:
    snap = table(s, d, "entity_snapshots").select("source", "id", "refresh_no", "name", "dob", "listed_on")
    return store.last_wins(snap, ["source", "id"], ["refresh_no"])


def content_signature(s: SparkSession, d: str) -> DataFrame:
    return store.content_signature(table(s, d, "sanctions_entities"), ["source"])


def lookup_left_default(s: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_or_default(_entities(s, d, "source"), table(s, d, "list_sources"), "source", "kind")


def semi_sanctions(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "list_sources").filter("kind = 'sanctions'")
    return lookup.semi(_entities(s, d, "source"), ref, "source")


def collect_docs_per_identity(s: SparkSession, d: str) -> DataFrame:
    e = _entities(s, d, "identifiers").select("id", F.explode(resolve.id_keys(resolve.id_list(F.col("identifiers")))).alias("k"))
    return lookup.collect_per_key(e, "id", "k", "documents")


def _aliases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sanctions_entities").filter("id is not null").select("id", F.explode(resolve.items(F.col("aliases"))).alias("alias")).distinct()


def normalize_aliases(s: SparkSession, d: str) -> DataFrame:
    return _aliases(s, d).select("id", "alias", text.normalize_name(F.col("alias")).alias("normal"))


def alias_tokens(s: SparkSession, d: str) -> DataFrame:
    return _aliases(s, d).select(F.explode(text.index_tokens(F.col("alias"))).alias("token"), "id").distinct()


def _alias_index(s: SparkSession, d: str) -> DataFrame:
    return retrieval.token_index(_entities(s, d, "aliases"), ("aliases",))


def prefix_candidates(s: SparkSession, d: str) -> DataFrame:
    """For every word of a listed alias that queries could use: the index tokens it is a prefix of."""
    idx = _alias_index(s, d)
    q = idx.filter(F.length("token") >= 3).select(F.col("token").alias("q")).distinct()
    return retrieval.prefix_matches(q, idx)


def screen_topk(s: SparkSession, d: str) -> DataFrame:
    return screen(subjects_of(table(s, d, "screenings")), _entities(s, d, *retrieval.COLUMNS)).select("subject", "id", "score", "position")


def bm25_candidates(s: SparkSession, d: str) -> DataFrame:
    subj = subjects_of(table(s, d, "screenings"))
    return retrieval.bm25_topk(query_rows(subj), retrieval.token_index(_entities(s, d, *retrieval.COLUMNS))).select("subject", "id", "rank_score", "ord")


def bm25_aliases(s: SparkSession, d: str) -> DataFrame:
    """Retrieval over the columns that SQL folds like the index does."""
    subj = subjects_of(table(s, d, "screenings"))
    cols = ("aliases", "phonetic_primary", "phonetic_alt")
    return retrieval.bm25_topk(query_rows(subj), retrieval.token_index(_entities(s, d, *cols), cols)).select("subject", "id", F.round("rank_score", 4).alias("rank_score"), "ord")


def phonetic_candidates(s: SparkSession, d: str) -> DataFrame:
    subj = subjects_of(table(s, d, "screenings"))
    lists = retrieval.bm25_lists(phonetic_rows(subj), retrieval.token_index(_entities(s, d, "phonetic_primary", "phonetic_alt"), ("phonetic_primary", "phonetic_alt")))
    return retrieval.in_rows(lists)


def soundex_names(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d, "name_ascii").select("id", text.soundex_words(F.col("name_ascii")).alias("code"))


def metaphone_names(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d, "name_ascii").select("id", text.metaphone(F.col("name_ascii")).alias("code"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of earlier decisions with both entries."""
    e = _entities(s, d, "source", "name", "dob", "nationality", "gender", "identifiers", "listed_on")
    p = table(s, d, "match_pairs").filter("id_a is not null and id_b is not null and id_a <> id_b").select(F.least("id_a", "id_b").alias("a_id"), F.greatest("id_a", "id_b").alias("b_id")).distinct()
    cols = ("source", "name", "dob", "nationality", "gender", "identifiers", "listed_on")
    return p.join(e.select(F.col("id").alias("a_id"), *[F.col(c).alias("a_" + c) for c in cols]), "a_id").join(e.select(F.col("id").alias("b_id"), *[F.col(c).alias("b_" + c) for c in cols]), "b_id")


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def lcs_similarity(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("a_id", "b_id", F.round(similarity.ratio(_lower("a_name"), _lower("b_name")), 4).alias("ratio"))


def token_similarity(s: SparkSession, d: str) -> DataFrame:
    a, b = _lower("a_name"), _lower("b_name")
    return _pairs(s, d).select("a_id", "b_id", F.round(similarity.bulk_token_sort(a, b), 4).alias("sort_ratio"), F.round(similarity.bulk_token_set(a, b), 4).alias("set_ratio"), F.round(similarity.bulk_weighted(a, b), 4).alias("weighted"))


def token_sort_similarity(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("a_id", "b_id", F.round(similarity.bulk_token_sort(_lower("a_name"), _lower("b_name")), 4).alias("ratio"))


def dedup_pairs(s: SparkSession, d: str) -> DataFrame:
    return resolve.judged_pairs(table(s, d, "match_pairs"), table(s, d, "sanctions_entities")).select("a_id", "b_id", "rule")


def dedup_components(s: SparkSession, d: str) -> DataFrame:
    return connected_components(table(s, d, "match_pairs").filter("merged").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def dedup_persons(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "sanctions_entities")
    return resolve.persons(e, resolve.judged_pairs(resolve.blocked_pairs(e), e))


def _years(c: str) -> Column:
    return dates.birth_years(resolve.items(F.col(c)))


def birth_years(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d, "dob").select("id", F.array_join(F.transform(_years("dob"), lambda y: y.cast("string")), ",").alias("years"))


def rule_cascade(s: SparkSession, d: str) -> DataFrame:
    keys = lambda c: resolve.id_keys(resolve.id_list(F.col(c)))
    r = rules.compare(keys("a_identifiers"), keys("b_identifiers"), F.col("a_gender"), F.col("b_gender"), resolve.items(F.col("a_dob")), resolve.items(F.col("b_dob")), F.col("b_listed_on"))
    return _pairs(s, d).select("a_id", "b_id", r.alias("route"))


def messy_dates(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sanctions_entities").select(F.explode(resolve.items(F.col("dob"))).alias("raw")).distinct()
    return x.select("raw", dates.messy_date(F.col("raw")).alias("parsed"))


def guard_no_data(s: SparkSession, d: str) -> DataFrame:
    ids = resolve.id_list(F.col("identifiers"))
    v = decide.no_data_guard(F.lit("CLEARED"), F.array("source"), resolve.items(F.col("dob")), resolve.items(F.col("nationality")), F.transform(ids, lambda i: F.coalesce(i["value"], F.lit(""))))
    return _entities(s, d, "source", "dob", "nationality", "identifiers").select("source", v.alias("verdict")).groupBy("source", "verdict").agg(F.count("*").alias("n"))


def verdict_rollup(s: SparkSession, d: str) -> DataFrame:
    m = report.match_rows(table(s, d, "screenings"))
    g = m.groupBy("id").agg(F.count_if(F.col("decision") == "LIKELY_MATCH").alias("likely"), F.count_if(F.col("decision") == "ESCALATE").alias("escalated"))
    return g.select("id", rules.verdict(F.col("likely"), F.col("escalated")).alias("verdict"))


def batch_numbers(s: SparkSession, d: str) -> DataFrame:
    n = decide.numbered(_entities(s, d, "source"), "source", ["id"])
    return n.select("source", "id", "match_number", decide.batch_number(F.col("match_number")).alias("batch_no"))


def override_join(s: SparkSession, d: str) -> DataFrame:
    m = report.match_rows(table(s, d, "screenings")).select(F.col("id").alias("screening_id"), "match_number", F.col("decision").alias("verdict"), F.col("cleared_by").alias("reasoning"))
    second = m.filter("verdict = 'ESCALATE'").select("screening_id", "match_number", F.lit("REVIEWED").alias("verdict"), F.lit("second pass").alias("reasoning"))
    return decide.override(m, second, ["screening_id", "match_number"])


def funnel_counts(s: SparkSession, d: str) -> DataFrame:
    cols = ("raw_candidates", "unique_persons", "auto_cleared", "auto_flagged", "sent_to_llm", "llm_cleared", "llm_flagged", "llm_escalated")
    return table(s, d, "screenings").distinct().groupBy("result").agg(F.count("*").alias("screenings"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in cols])


def source_status(s: SparkSession, d: str) -> DataFrame:
    return report.source_status(table(s, d, "source_metadata"))


def status_totals(s: SparkSession, d: str) -> DataFrame:
    return report.source_status(table(s, d, "source_metadata")).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("entity_count").alias("entities"))


def history_page(s: SparkSession, d: str) -> DataFrame:
    return report.history_page(table(s, d, "screenings"), 50, 50).select("id", "result", "screened_by")


def json_fields(s: SparkSession, d: str) -> DataFrame:
    j = lambda f: F.coalesce(F.trim(F.get_json_object("user_input", f"$.{f}")), F.lit(""))
    return table(s, d, "screenings").select("id", *[j(f).alias(f) for f in ("name", "dob", "nationality", "passport")]).distinct()


def json_guarded_parse(s: SparkSession, d: str) -> DataFrame:
    ids = resolve.id_list(F.col("identifiers"))
    return _entities(s, d, "identifiers").select("id", F.size(ids).alias("documents"), F.array_join(F.transform(ids, lambda i: F.concat_ws(":", i["type"], i["value"], i["country"])), "; ").alias("listed"))


def report_rows(s: SparkSession, d: str) -> DataFrame:
    return report.report_row(_entities(s, d, "name", "aliases", "dob", "nationality", "gender", "source", "identifiers"))


def union_priority_dedup(s: SparkSession, d: str) -> DataFrame:
    live = _entities(s, d, "source").select("source", "id", F.lit("live").alias("origin"))
    old = table(s, d, "entity_snapshots").filter("id is not null").select("source", "id", F.lit("snapshot").alias("origin")).distinct()
    return retrieval.union_by_priority([live, old], ["source", "id"])


def audit_by_day(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "screenings").distinct()
    return t.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "screened_by").agg(F.count("*").alias("screenings"), F.sum(F.coalesce("processing_ms", F.lit(0))).alias("total_ms"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return diff_snapshots(table(s, d, "entity_snapshots"), table(s, d, "source_metadata"))


def token_set_similarity(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("a_id", "b_id", F.round(similarity.bulk_token_set(_lower("a_name"), _lower("b_name")), 4).alias("ratio"))


def id_match(s: SparkSession, d: str) -> DataFrame:
    keys = lambda c: resolve.id_keys(resolve.id_list(F.col(c)))
    return _pairs(s, d).select("a_id", "b_id", F.array_join(F.array_sort(F.array_intersect(keys("a_identifiers"), keys("b_identifiers"))), "; ").alias("shared")).filter("shared <> ''")


def gender_conflict(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).filter(rules.gender_conflict(F.col("a_gender"), F.col("b_gender"))).select("a_id", "b_id")


def dob_gap(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("a_id", "b_id", dates.year_gap(_years("a_dob"), _years("b_dob")).alias("gap")).filter("gap is not null")


def temporal(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).filter(dates.impossible_age(_years("a_dob"), F.col("b_listed_on"))).select("a_id", "b_id")


def doubt_wording(s: SparkSession, d: str) -> DataFrame:
    """Texts that voice doubt, with the first of the fixed wordings they hold."""
    return table(s, d, "documents").select("doc_id", decide.doubt_in(F.col("text")).alias("wording")).filter("wording is not null")


def report_json(s: SparkSession, d: str) -> DataFrame:
    return report.screening_json(table(s, d, "screenings").distinct())


def screening_labels(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "screenings").filter("id is not null and created_at is not null").select("id", "created_at").distinct()
    return t.select("id", report.screening_label(F.col("created_at"), F.col("id")).alias("label"))


def ages(s: SparkSession, d: str) -> DataFrame:
    """Age at the screening, by the year typed first."""
    t = table(s, d, "screenings").select("id", "created_at", F.get_json_object("user_input", "$.dob").alias("dob")).distinct()
    return t.select("id", dates.age(F.col("dob"), F.year("created_at")).alias("age")).filter("age is not null").distinct()


def history_total(s: SparkSession, d: str) -> DataFrame:
    return report.history_total(table(s, d, "screenings"))


def healthy_versions(s: SparkSession, d: str) -> DataFrame:
    return report.healthy_versions(table(s, d, "source_metadata"))


def phrase_candidates(s: SparkSession, d: str) -> DataFrame:
    """Entities whose aliases hold the words of another's first alias in a row, for aliases of two words or more."""
    e = _entities(s, d, "aliases")
    q = e.select(F.col("id").alias("subject"), text.token_list(F.get(resolve.items(F.col("aliases")), 0)).alias("phrase"))
    return retrieval.phrase_matches(q, e, retrieval.token_index(e, ("aliases",)), ("aliases",))


_ALL = (
    bm25_aliases, token_set_similarity, id_match, gender_conflict, dob_gap, temporal, doubt_wording, report_json, screening_labels, ages, history_total, healthy_versions, phrase_candidates,
    scan_filter_project, point_lookup, upsert_last_wins, content_signature, lookup_left_default, semi_sanctions, collect_docs_per_identity, normalize_aliases, alias_tokens,
    prefix_candidates, screen_topk, bm25_candidates, phonetic_candidates, soundex_names, metaphone_names, lcs_similarity, token_sort_similarity, token_similarity, dedup_pairs,
    dedup_components, dedup_persons, birth_years, rule_cascade, messy_dates, guard_no_data, verdict_rollup, batch_numbers, override_join, funnel_counts, source_status, status_totals,
    history_page, json_fields, json_guarded_parse, report_rows, union_priority_dedup, audit_by_day, p6_found,
)


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            ship(s)
            return f(s, d)

        return run

    return {f.__name__: shipped(f) for f in _ALL}


# --- the same in SQL ----------------------------------------------------------------------------

_E = "ent AS (SELECT DISTINCT * FROM sanctions_entities WHERE id IS NOT NULL)"
_ITEMS = "list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"
_IDS = "(CASE WHEN json_valid(coalesce(identifiers, '')) AND json_type(identifiers) = 'ARRAY' THEN from_json(identifiers, '[{{\"type\":\"VARCHAR\",\"value\":\"VARCHAR\",\"country\":\"VARCHAR\"}}]') ELSE [] END)".replace("{{", "{").replace("}}", "}")
_KEYS = "list_sort(list_distinct(list_transform(list_filter({i}, lambda i: trim(i.type) <> '' AND trim(i.value) <> ''), lambda i: lower(trim(i.type)) || ':' || lower(trim(i.value)))))"
_ALIASES = "al AS (SELECT DISTINCT id, unnest(" + _ITEMS.format(c="aliases") + ") AS alias FROM sanctions_entities WHERE id IS NOT NULL)"
_FOLD = "lower(strip_accents({c}))"
_TOKENS = "list_distinct(list_filter(string_split_regex(" + _FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_LCS = "list_last(list_reduce(string_split({a}, ''), lambda r, c: list_reduce(range(1, length({b}) + 1), lambda acc, i: list_append(acc, CASE WHEN {b}[i] = c THEN r[i] + 1 ELSE greatest(r[i + 1], acc[i]) END), [0::BIGINT]), [0::BIGINT for z in range(length({b}) + 1)]))"
_RATIO = "CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * " + _LCS + " / (length({a}) + length({b})) END"
_SORTED = "array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')), ' ')"
_PAIRS = (
    _E + ", pr AS (SELECT DISTINCT least(id_a, id_b) AS a_id, greatest(id_a, id_b) AS b_id FROM match_pairs WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND id_a <> id_b), "
    "jn AS (SELECT a_id, b_id, a.source AS a_source, b.source AS b_source, lower(coalesce(a.name, '')) AS a_name, lower(coalesce(b.name, '')) AS b_name, a.dob AS a_dob, b.dob AS b_dob, a.nationality AS a_nat, b.nationality AS b_nat, "
    "lower(trim(coalesce(a.gender, ''))) AS a_g, lower(trim(coalesce(b.gender, ''))) AS b_g, a.identifiers AS a_ids, b.identifiers AS b_ids, b.listed_on AS b_listed FROM pr JOIN ent a ON a.id = a_id JOIN ent b ON b.id = b_id)"
)


_WORDS = "list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> ''))"
_TEXT = "array_to_string(list_sort({l}), ' ')"
_SETS = (
    "ws AS (SELECT a_id, b_id, " + _WORDS.format(c="a_name") + " AS sa, " + _WORDS.format(c="b_name") + " AS sb FROM jn), "
    "sets AS (SELECT a_id, b_id, sa, sb, " + _TEXT.format(l="list_intersect(sa, sb)") + " AS i, " + _TEXT.format(l="list_filter(sa, lambda w: NOT list_contains(sb, w))") + " AS x, " + _TEXT.format(l="list_filter(sb, lambda w: NOT list_contains(sa, w))") + " AS y FROM ws)"
)


def _keys_of(c: str) -> str:
    return _KEYS.format(i=_IDS.replace("identifiers", c))


def _years_of(c: str) -> str:
    return "list_filter(list_transform(" + _ITEMS.format(c=c) + ", lambda x: try_cast(trim(substr(trim(x), 1, 4)) AS INTEGER)), lambda y: y BETWEEN 1900 AND 2100)"


_NOISE = ", ".join(f"'{w}'" for w in text.NOISE)
_MONTH = "list_position([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "], lower(substr(regexp_extract(t, '^(\\d{1,2})\\s+(\\w+)\\s+(\\d{4})', 2), 1, 3)))"
_ISO, _SLASH, _WORD = "'^(\\d{4})-(\\d{1,2})-(\\d{1,2})'", "'^(\\d{1,2})/(\\d{1,2})/(\\d{4})'", "'^(\\d{1,2})\\s+(\\w+)\\s+(\\d{4})'"

_SNAP_TEXT = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_SNAP_LIST = "array_to_string(list_sort(list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')), '|')"
_P6 = (
    "WITH att AS (SELECT *, row_number() OVER (PARTITION BY source, refresh_no ORDER BY last_fetched DESC, status DESC) AS rn FROM source_metadata), "
    "good AS (SELECT source, refresh_no, lag(refresh_no) OVER (PARTITION BY source ORDER BY refresh_no) AS prev_no FROM att WHERE rn = 1 AND status = 'ok'), "
    "canon AS (SELECT source, refresh_no, id, any_value(concat_ws('~', "
    + ", ".join(_SNAP_TEXT.format(c=c) for c in ("name", "designation", "listed_on"))
    + ", "
    + ", ".join(_SNAP_LIST.format(c=c) for c in ("aliases", "dob", "nationality", "programs"))
    + ", array_to_string(list_sort(list_transform("
    + _IDS
    + ", lambda i: concat_ws('^', "
    + ", ".join(_SNAP_TEXT.format(c="i." + c) for c in ("country", "type", "value"))
    + "))), '^^'))) AS h FROM entity_snapshots WHERE id IS NOT NULL GROUP BY source, refresh_no, id), "
    "pairs AS (SELECT * FROM good WHERE prev_no IS NOT NULL), "
    "nw AS (SELECT c.* FROM canon c JOIN pairs p USING (source, refresh_no)), "
    "od AS (SELECT c.source, p.refresh_no, c.id, c.h FROM canon c JOIN pairs p ON p.source = c.source AND p.prev_no = c.refresh_no) "
    "SELECT coalesce(nw.source, od.source) AS source, coalesce(nw.id, od.id) AS id, coalesce(nw.refresh_no, od.refresh_no) AS refresh_no, "
    "CASE WHEN od.h IS NULL THEN 'added' WHEN nw.h IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM nw FULL OUTER JOIN od ON nw.source = od.source AND nw.refresh_no = od.refresh_no AND nw.id = od.id WHERE nw.h IS DISTINCT FROM od.h"
)


def oracle_sql() -> dict[str, str]:
    matches = "mt AS (SELECT id, unnest(from_json(matches, '[{\"match_number\":\"INTEGER\",\"decision\":\"VARCHAR\",\"cleared_by\":\"VARCHAR\"}]')) AS m FROM (SELECT DISTINCT id, matches FROM screenings WHERE json_valid(coalesce(matches, ''))))"
    latest = "att AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_fetched DESC, status DESC, entity_count DESC) AS rn FROM source_metadata), st AS (SELECT source, last_fetched, status, coalesce(entity_count, 0)::BIGINT AS entity_count FROM att WHERE rn = 1)"
    j = lambda f: f"coalesce(trim(user_input ->> '$.{f}'), '') AS {f}"
    funnel = ", ".join(f"sum(coalesce({c}, 0))::BIGINT AS {c}" for c in ("raw_candidates", "unique_persons", "auto_cleared", "auto_flagged", "sent_to_llm", "llm_cleared", "llm_flagged", "llm_escalated"))
    label = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.LABELS.items()) + " ELSE source END"
    hard = ", ".join(f"'{x}'" for x in decide.HARD_LISTS)
    ya, yb = _years_of("a_dob"), _years_of("b_dob")
    sorted_ratio = _RATIO.format(a="sa", b="sb")
    return {
        "bm25_aliases": f"WITH {_E}, raw AS (SELECT id, unnest(list_concat({', '.join(_TOKENS.format(c=f"coalesce({c}, '')") for c in ('aliases', 'phonetic_primary', 'phonetic_alt'))})) AS token FROM ent), "
        "ix AS (SELECT id, token, count(*) AS tf FROM raw GROUP BY id, token), ln AS (SELECT id, sum(tf) AS len FROM ix GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln), "
        "nm AS (SELECT DISTINCT trim(user_input ->> '$.name') AS subject FROM screenings WHERE trim(user_input ->> '$.name') <> ''), "
        f"tk AS (SELECT subject, {_TOKENS.format(c='subject')} AS t FROM nm), lg AS (SELECT subject, t, list_filter(t, lambda x: length(x) >= 3) AS l FROM tk), qs AS (SELECT subject, unnest(CASE WHEN len(l) > 0 THEN l ELSE t END) AS q FROM lg), "
        "mt AS (SELECT q, token FROM (SELECT DISTINCT q FROM qs) JOIN (SELECT DISTINCT token FROM ix) ON starts_with(token, q)), po AS (SELECT q, id, sum(tf)::DOUBLE AS tf FROM mt JOIN ix USING (token) GROUP BY q, id), "
        "df AS (SELECT q, count(*) AS df FROM po GROUP BY q), "
        "sc AS (SELECT subject, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))), 6) AS s FROM qs JOIN df USING (q) JOIN po USING (q) JOIN ln USING (id), st GROUP BY subject, id), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY s DESC, id) AS ord FROM sc) SELECT subject, id, round(s, 4) AS rank_score, ord::INTEGER AS ord FROM rk WHERE ord <= 300",
        "token_set_similarity": f"WITH {_PAIRS}, {_SETS}, parts AS (SELECT a_id, b_id, i, x, y, sa, sb, trim(concat_ws(' ', nullif(i, ''), nullif(x, ''))) AS ia, trim(concat_ws(' ', nullif(i, ''), nullif(y, ''))) AS ib FROM sets) "
        f"SELECT a_id, b_id, round(CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 WHEN i <> '' AND (x = '' OR y = '') THEN 100.0 WHEN i = '' THEN {_RATIO.format(a='ia', b='ib')} ELSE greatest({_RATIO.format(a='ia', b='ib')}, 200.0 * length(i) / (length(i) + length(ia)), 200.0 * length(i) / (length(i) + length(ib))) END, 4) AS ratio FROM parts",
        "id_match": f"WITH {_PAIRS}, k AS (SELECT a_id, b_id, array_to_string(list_sort(list_intersect({_keys_of('a_ids')}, {_keys_of('b_ids')})), '; ') AS shared FROM jn) SELECT * FROM k WHERE shared <> ''",
        "gender_conflict": f"WITH {_PAIRS} SELECT a_id, b_id FROM jn WHERE a_g <> '' AND b_g <> '' AND a_g <> b_g",
        "dob_gap": f"WITH {_PAIRS} SELECT a_id, b_id, list_min(flatten(list_transform({ya}, lambda x: list_transform({yb}, lambda y: abs(x - y)))))::INTEGER AS gap FROM jn WHERE len({ya}) > 0 AND len({yb}) > 0",
        "temporal": f"WITH {_PAIRS} SELECT a_id, b_id FROM jn WHERE try_cast(substr(trim(b_listed), 1, 4) AS INTEGER) - list_min({ya}) < 15",
        "doubt_wording": "SELECT doc_id, wording FROM (SELECT doc_id, list_filter([" + ", ".join(f"'{w}'" for w in decide.DOUBT) + "], lambda p: contains(lower(text), p))[1] AS wording FROM documents WHERE text IS NOT NULL) WHERE wording IS NOT NULL",
        "report_json": "SELECT id, to_json({'id': coalesce(id, ''), 'result': coalesce(result, ''), 'screened_by': coalesce(screened_by, ''), 'stats': {" + ", ".join(f"'{c}': coalesce({c}, 0)" for c in report.STATS) + "}, 'matches': coalesce(matches, '[]')})::VARCHAR AS report FROM (SELECT DISTINCT * FROM screenings)",
        "screening_labels": "SELECT DISTINCT id, 'SCR-' || strftime(created_at, '%Y%m%d') || '-' || upper(substr(sha256(id), 1, 6)) AS label FROM screenings WHERE id IS NOT NULL AND created_at IS NOT NULL",
        "ages": "SELECT DISTINCT id, age FROM (SELECT id, (year(created_at) - try_cast(substr(trim(user_input ->> '$.dob'), 1, 4) AS INTEGER))::INTEGER AS age FROM screenings WHERE regexp_matches(trim(user_input ->> '$.dob'), '^\\d{4}')) WHERE age IS NOT NULL",
        "history_total": "SELECT count(*) AS total FROM (SELECT DISTINCT id, created_at, result, screened_by FROM screenings)",
        "healthy_versions": "WITH att AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_fetched DESC, status DESC, entity_count DESC, file_hash DESC NULLS LAST) AS rn FROM source_metadata) SELECT string_agg(source || '=' || coalesce(file_hash, ''), ';' ORDER BY source) AS versions FROM att WHERE rn = 1 AND status = 'ok'",
        "phrase_candidates": f"WITH {_E}, e AS (SELECT DISTINCT id, ' ' || array_to_string(list_filter(string_split_regex({_FOLD.format(c='coalesce(aliases, chr(32))')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM ent), "
        f"q AS (SELECT DISTINCT id AS subject, list_filter(string_split_regex({_FOLD.format(c="coalesce((" + _ITEMS.format(c='aliases') + ")[1], chr(32))")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS p FROM ent) SELECT DISTINCT subject, e.id FROM q JOIN e ON contains(t, ' ' || array_to_string(p, ' ') || ' ') WHERE len(p) >= 2",
        "scan_filter_project": "SELECT id, source, name, designation FROM sanctions_entities WHERE source IN ('wikidata_peps', 'us_congress', 'uk_parliament', 'eu_parliament')",
        "point_lookup": "SELECT DISTINCT id, result, processing_ms FROM screenings WHERE id = (SELECT min(id) FROM screenings)",
        "upsert_last_wins": "SELECT source, id, refresh_no, name, dob, listed_on FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY refresh_no DESC NULLS LAST, name DESC NULLS LAST, dob DESC NULLS LAST, listed_on DESC NULLS LAST) AS rn FROM entity_snapshots) WHERE rn = 1",
        "content_signature": "SELECT source, sha256(string_agg(id, '|' ORDER BY id)) AS signature FROM (SELECT DISTINCT source, id FROM sanctions_entities WHERE id IS NOT NULL) GROUP BY source",
        "lookup_left_default": f"WITH {_E}, ref AS (SELECT source, max(kind) AS kind FROM list_sources GROUP BY source) SELECT id, source, coalesce(kind, '') AS kind FROM ent LEFT JOIN ref USING (source)",
        "semi_sanctions": f"WITH {_E} SELECT id, source FROM ent WHERE source IN (SELECT source FROM list_sources WHERE kind = 'sanctions')",
        "collect_docs_per_identity": f"WITH {_E}, k AS (SELECT id, unnest({_keys_of('identifiers')}) AS k FROM ent) SELECT id, string_agg(DISTINCT k, '; ' ORDER BY k) AS documents FROM k GROUP BY id",
        "normalize_aliases": f"WITH {_ALIASES} SELECT id, alias, array_to_string(list_filter(string_split_regex(trim(replace(regexp_replace({_FOLD.format(c='alias')}, '[+\\-*\"():\\^.,]', ' ', 'g'), '''', '')), '\\s+'), lambda w: w <> '' AND w NOT IN ({_NOISE})), ' ') AS normal FROM al",
        "alias_tokens": f"WITH {_ALIASES}, tk AS (SELECT id, unnest({_TOKENS.format(c='alias')}) AS token FROM al) SELECT DISTINCT token, id FROM tk",
        "prefix_candidates": f"WITH {_ALIASES}, tk AS (SELECT DISTINCT unnest({_TOKENS.format(c='alias')}) AS token FROM al) SELECT q.token AS q, t.token AS token FROM tk q JOIN tk t ON starts_with(t.token, q.token) WHERE length(q.token) >= 3",
        "lcs_similarity": f"WITH {_PAIRS} SELECT a_id, b_id, round({_RATIO.format(a='a_name', b='b_name')}, 4) AS ratio FROM jn",
        "token_sort_similarity": f"WITH {_PAIRS}, sd AS (SELECT a_id, b_id, {_SORTED.format(c='a_name')} AS sa, {_SORTED.format(c='b_name')} AS sb FROM jn) SELECT a_id, b_id, round({sorted_ratio}, 4) AS ratio FROM sd",
        "dedup_pairs": f"WITH {_PAIRS}, sd AS (SELECT *, {_SORTED.format(c='a_name')} AS sa, {_SORTED.format(c='b_name')} AS sb FROM jn), sm AS (SELECT *, round(({sorted_ratio}) / 100, 6) AS sim FROM sd) "
        f"SELECT a_id, b_id, CASE WHEN list_has_any({_keys_of('a_ids')}, {_keys_of('b_ids')}) THEN 1 WHEN sim > 0.90 AND list_has_any({_ITEMS.format(c='a_dob')}, {_ITEMS.format(c='b_dob')}) THEN 2 "
        f"WHEN sim > 0.95 AND list_has_any({_ITEMS.format(c='upper(a_nat)')}, {_ITEMS.format(c='upper(b_nat)')}) THEN 3 WHEN sim > 0.97 AND a_source <> b_source AND a_source <> '' AND b_source <> '' THEN 4 ELSE 0 END AS rule FROM sm",
        "dedup_components": "WITH RECURSIVE ed AS (SELECT id_a AS a, id_b AS b FROM match_pairs WHERE merged AND id_a <> id_b UNION SELECT id_b, id_a FROM match_pairs WHERE merged AND id_a <> id_b), reach AS (SELECT a AS id, a AS root FROM ed WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT e.b, r.root FROM reach r JOIN ed e ON e.a = r.id WHERE e.b IS NOT NULL) SELECT id, min(root) AS component FROM reach GROUP BY id",
        "birth_years": f"WITH {_E} SELECT id, array_to_string({_years_of('dob')}, ',') AS years FROM ent",
        "rule_cascade": f"WITH {_PAIRS} SELECT a_id, b_id, CASE WHEN list_has_any({_keys_of('a_ids')}, {_keys_of('b_ids')}) THEN 'id' WHEN a_g <> '' AND b_g <> '' AND a_g <> b_g THEN 'gender' "
        f"WHEN list_min(flatten(list_transform({ya}, lambda x: list_transform({yb}, lambda y: abs(x - y))))) > 10 THEN 'dob' WHEN try_cast(substr(trim(b_listed), 1, 4) AS INTEGER) - list_min({ya}) < 15 THEN 'temporal' ELSE 'review' END AS route FROM jn",
        "messy_dates": f"WITH r AS (SELECT DISTINCT unnest({_ITEMS.format(c='dob')}) AS raw FROM sanctions_entities), x AS (SELECT raw, trim(raw) AS t FROM r) SELECT raw, CASE "
        "WHEN regexp_matches(t, '(?i)^between\\s+(\\d{4})\\s+and\\s+(\\d{4})') THEN regexp_extract(t, '(?i)^between\\s+(\\d{4})\\s+and\\s+(\\d{4})', 1) || '-' || regexp_extract(t, '(?i)^between\\s+(\\d{4})\\s+and\\s+(\\d{4})', 2) "
        "WHEN regexp_matches(t, '(?i)^(?:circa|approx(?:imately)?)\\s+(\\d{4})') THEN '~' || regexp_extract(t, '(?i)^(?:circa|approx(?:imately)?)\\s+(\\d{4})', 1) "
        f"WHEN regexp_matches(t, {_ISO}) THEN regexp_extract(t, {_ISO}, 1) || '-' || lpad(regexp_extract(t, {_ISO}, 2), 2, '0') || '-' || lpad(regexp_extract(t, {_ISO}, 3), 2, '0') "
        f"WHEN regexp_matches(t, {_SLASH}) THEN regexp_extract(t, {_SLASH}, 3) || '-' || lpad(regexp_extract(t, {_SLASH}, 2), 2, '0') || '-' || lpad(regexp_extract(t, {_SLASH}, 1), 2, '0') "
        f"WHEN regexp_matches(t, {_WORD}) AND {_MONTH} > 0 THEN regexp_extract(t, {_WORD}, 3) || '-' || lpad(({_MONTH})::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(t, {_WORD}, 1), 2, '0') "
        "WHEN regexp_matches(t, '^\\d{4}$') THEN t WHEN try_cast(regexp_extract(t, '\\b(\\d{4})\\b', 1) AS INTEGER) BETWEEN 1900 AND 2030 THEN regexp_extract(t, '\\b(\\d{4})\\b', 1) ELSE '' END AS parsed FROM x",
        "guard_no_data": f"WITH {_E} SELECT source, CASE WHEN source IN ({hard}) AND len({_ITEMS.format(c='dob')}) = 0 AND len({_ITEMS.format(c='nationality')}) = 0 AND len(list_filter({_IDS}, lambda i: coalesce(i.value, '') <> '')) = 0 THEN 'ESCALATE' ELSE 'CLEARED' END AS verdict, count(*) AS n FROM ent GROUP BY 1, 2",
        "verdict_rollup": f"WITH {matches} SELECT id, CASE WHEN count_if(m.decision = 'LIKELY_MATCH') > 0 THEN 'FLAG' WHEN count_if(m.decision = 'ESCALATE') > 0 THEN 'ESCALATE' ELSE 'CLEAR' END AS verdict FROM mt GROUP BY id",
        "batch_numbers": "SELECT source, id, rn::INTEGER AS match_number, ((rn - 1) // 25)::INTEGER AS batch_no FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM (SELECT DISTINCT source, id FROM sanctions_entities WHERE id IS NOT NULL))",
        "override_join": f"WITH {matches}, v AS (SELECT id AS screening_id, m.match_number AS match_number, CASE WHEN m.decision = 'ESCALATE' THEN 'REVIEWED' ELSE m.decision END AS verdict, CASE WHEN m.decision = 'ESCALATE' THEN 'second pass' ELSE m.cleared_by END AS reasoning FROM mt) SELECT * FROM v",
        "funnel_counts": f"SELECT result, count(*) AS screenings, {funnel} FROM (SELECT DISTINCT * FROM screenings) GROUP BY result",
        "source_status": f"WITH {latest} SELECT * FROM st",
        "status_totals": f"WITH {latest} SELECT count(*) AS sources, count_if(status = 'ok')::BIGINT AS ok, count_if(status <> 'ok')::BIGINT AS failed, sum(entity_count)::BIGINT AS entities FROM st",
        "history_page": "SELECT id, result, screened_by FROM (SELECT DISTINCT id, created_at, result, screened_by FROM screenings) ORDER BY created_at DESC, id LIMIT 50 OFFSET 50",
        "json_fields": f"SELECT DISTINCT id, {', '.join(j(f) for f in ('name', 'dob', 'nationality', 'passport'))} FROM screenings",
        "json_guarded_parse": f"WITH {_E} SELECT id, len({_IDS})::INTEGER AS documents, array_to_string(list_transform({_IDS}, lambda i: concat_ws(':', i.type, i.value, i.country)), '; ') AS listed FROM ent",
        "report_rows": f"WITH {_E} SELECT id, coalesce(name, '') AS matched_person, array_to_string(list_slice({_ITEMS.format(c='aliases')}, 1, 4), ', ') AS aliases, array_to_string({_ITEMS.format(c='dob')}, ', ') AS dob, array_to_string({_ITEMS.format(c='nationality')}, ', ') AS nationality, "
        f"coalesce(gender, '') AS gender, {label} AS source_list, array_to_string(list_transform(list_slice({_IDS}, 1, 3), lambda i: i.type || ': ' || i.value), '; ') AS identifiers FROM ent",
        "union_priority_dedup": "WITH l AS (SELECT DISTINCT source, id FROM sanctions_entities WHERE id IS NOT NULL), o AS (SELECT DISTINCT source, id FROM entity_snapshots WHERE id IS NOT NULL) SELECT source, id, 'live' AS origin FROM l UNION ALL SELECT o.source, o.id, 'snapshot' FROM o ANTI JOIN l USING (source, id)",
        "audit_by_day": "SELECT strftime(created_at, '%Y-%m') AS month, screened_by, count(*) AS screenings, sum(coalesce(processing_ms, 0))::BIGINT AS total_ms FROM (SELECT DISTINCT * FROM screenings) GROUP BY 1, 2",
        "p6_found": _P6,
    }
