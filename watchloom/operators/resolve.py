"""Entity resolution across lists: pair rules, groups, and one merged person a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import bulk_ratio, sorted_words
from ..session import materialize
from .components import connected_components

IDENTIFIERS = "array<struct<type:string,value:string,country:string>>"


def items(c: Column) -> Column:
    """Trimmed non-empty items of a ``|`` list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def id_list(c: Column) -> Column:
    """A JSON identifiers field as an array; text that can't be read gives an empty one."""
    return F.coalesce(F.from_json(c, IDENTIFIERS), F.array().cast(IDENTIFIERS))


def id_keys(ids: Column) -> Column:
    """``type:value`` keys, lower case and trimmed, of identifiers that have both."""
    keys = F.transform(ids, lambda i: F.struct(F.lower(F.trim(i["type"])).alias("t"), F.lower(F.trim(i["value"])).alias("v")))
    return F.array_distinct(F.transform(F.filter(keys, lambda k: (k["t"] != "") & (k["v"] != "")), lambda k: F.concat(k["t"], F.lit(":"), k["v"])))


def prepared(entities: DataFrame) -> DataFrame:
    """id, source, name, dobs, nats, keys of every entity, one row an id."""
    e = entities.filter("id is not null").groupBy("id").agg(F.min(F.struct("source", "name", "dob", "nationality", "identifiers")).alias("e")).select("id", "e.*")
    return e.select("id", "source", F.lower(F.coalesce("name", F.lit(""))).alias("name"), items(F.col("dob")).alias("dobs"), F.transform(items(F.col("nationality")), F.upper).alias("nats"), id_keys(id_list(F.col("identifiers"))).alias("keys"))


def merge_rule(a: str = "a", b: str = "b") -> Column:
    """The first rule that merges a pair: 1 shared identifier, 2 name and birth date, 3 name and country, 4 name alone; else 0."""
    A, B = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    sim = F.col("similarity")
    return (
        F.when(F.arrays_overlap(A("keys"), B("keys")), 1)
        .when((sim > 0.90) & F.arrays_overlap(A("dobs"), B("dobs")), 2)
        .when((sim > 0.95) & F.arrays_overlap(A("nats"), B("nats")), 3)
        .when((sim > 0.97) & (A("source") != B("source")) & (A("source") != "") & (B("source") != ""), 4)
        .otherwise(0)
    )


def judged_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """a_id, b_id, similarity, rule, uncertain of every distinct pair (id_a, id_b) of listed entities."""
    p = prepared(entities)
    cols = p.columns
    one = pairs.filter("id_a is not null and id_b is not null and id_a <> id_b").select(F.least("id_a", "id_b").alias("a_id"), F.greatest("id_a", "id_b").alias("b_id")).distinct()
    j = one.join(p.select(F.col("id").alias("a_id"), F.struct(*cols).alias("a")), "a_id").join(p.select(F.col("id").alias("b_id"), F.struct(*cols).alias("b")), "b_id")
    j = j.withColumn("similarity", F.round(bulk_ratio(sorted_words(F.col("a.name")), sorted_words(F.col("b.name"))) / 100, 6)).withColumn("rule", merge_rule())
    return j.select("a_id", "b_id", "similarity", "rule", F.col("rule").isin(3, 4).alias("uncertain"))


_KEYS = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("index", "probe")])


def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` even segments of ``n`` letters."""
    return [(n * i // parts, n * (i + 1) // parts - n * i // parts) for i in range(parts)]


def _edits(a: int, b: int, percent: int) -> int:
    """Most insertions and deletions between texts of ``a`` and ``b`` letters whose ratio is above ``percent``; below |a - b| there are none."""
    d = ((100 - percent) * (a + b) - 1) // 100
    return d - (d - abs(a - b)) % 2


def segment_keys(s: str, percent: int) -> tuple[list[str], list[str]]:
    """Keys of a text as the shorter and as the longer of a pair: different texts with a ratio above ``percent`` share one.

    With at most d edits, one of d + 1 segments of the shorter text stands whole in the longer one, shifted by
    no more than the edits on either side of it allow.
    """
    n, index, probe = len(s), set(), set()
    m = n
    while n and (d := _edits(n, m, percent)) >= m - n:
        if d:
            index.update(f"{n}|{d}|{i}|{s[p : p + w]}" for i, (p, w) in enumerate(_segments(n, d + 1)))
        m += 1
    m = n
    while m and (d := _edits(m, n, percent)) >= n - m:
        if d:
            for i, (p, w) in enumerate(_segments(m, d + 1)):
                for x in range(p - (d - n + m) // 2, p + (d + n - m) // 2 + 1):
                    if x >= 0 and x + w <= n:
                        probe.add(f"{m}|{d}|{i}|{s[x : x + w]}")
        m -= 1
    return sorted(index), sorted(probe)


def similar_texts(texts: DataFrame, percent: int, within: str | None = None) -> DataFrame:
    """[within,] s1, s2, similarity: all pairs of different texts ``s`` (of one ``within``) with a ratio above ``percent``, both ways round."""

    @F.pandas_udf(_KEYS)
    def keys(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segment_keys(x, percent) for x in s], columns=["index", "probe"])

    by = [within] if within else []
    t = materialize(texts.select("s").distinct().withColumn("k", keys("s")).select("s", "k.index", "k.probe"))
    t = texts.select(*by, "s").distinct().join(t, "s")
    side = lambda c, name: t.select(*by, F.col("s").alias(name), F.explode(c).alias("k")).select(*by, name, F.xxhash64(*by, "k").alias("k"))
    met = side("index", "x").join(side("probe", "y"), ["k", *by]).filter("x <> y").select(*by, F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("s2")).distinct()
    one = materialize(met.withColumn("similarity", F.round(bulk_ratio("s1", "s2") / 100, 6)).filter(F.col("similarity") > percent / 100))
    return one.unionByName(one.select(*by, F.col("s2").alias("s1"), F.col("s1").alias("s2"), "similarity"))


def blocked_pairs(entities: DataFrame) -> DataFrame:
    """Pairs whose judgement gives the same persons, and the same uncertainty of each, as that of all pairs.

    Rules 1 and 2 merge all holders of a document key, and all bearers of a name with a birth date: each is linked to
    the smallest id.  For rules 3 and 4 a cell holds the bearers of a name in a country, or of a name in a source;
    the rule merges all pairs of two cells, so every member is linked to the other cell's smallest id.
    Where those links leave open whether a pair of two cells is uncertain (has no key and no birth date in common),
    the first such pair is added.
    """
    p = materialize(prepared(entities).withColumn("s", sorted_words(F.col("name"))).withColumn("certain", F.array_distinct(F.concat(
        F.transform("keys", lambda k: F.concat(F.lit("i:"), k)), F.transform("dobs", lambda d: F.concat(F.lit("d:"), d))))))

    def star(members: DataFrame, by: list[str]) -> DataFrame:
        return members.join(members.groupBy(*by).agg(F.min("id").alias("to")), by).select("id", "to")

    held = star(p.select("id", F.explode("keys").alias("key")), ["key"])
    born = p.select("id", "s", F.explode(F.array_distinct("dobs")).alias("dob"))
    first = born.groupBy("dob", "s").agg(F.min("id").alias("id"))
    alike = similar_texts(born, 90, "dob")
    near = alike.join(first.select("dob", F.col("s").alias("s1"), "id"), ["dob", "s1"]).join(first.select("dob", F.col("s").alias("s2"), F.col("id").alias("to")), ["dob", "s2"]).select("id", "to")

    country = p.select(F.lit(3).alias("rule"), F.explode(F.array_distinct("nats")).alias("part"), "s", "id", "certain")
    source = p.filter("source <> ''").select(F.lit(4).alias("rule"), F.col("source").alias("part"), "s", "id", "certain")
    members = materialize(country.unionByName(source))
    cell = ["rule", "part", "s"]
    always = members.select(*cell, F.explode("certain").alias("c")).groupBy(*cell, "c").agg(F.count("*").alias("m"))
    cells = members.groupBy(*cell).agg(F.count("*").alias("n"), F.min(F.struct("id", "certain")).alias("first"))
    whole = always.join(cells.select(*cell, "n"), cell).filter("m = n").groupBy(*cell).agg(F.collect_list("c").alias("always"))
    cells = materialize(cells.join(whole, cell, "left").select(*cell, "n", "first", F.coalesce("always", F.array().cast("array<string>")).alias("always")))
    names = similar_texts(p, 95).unionByName(p.select(F.col("s").alias("s1"), F.col("s").alias("s2"), F.lit(1.0).alias("similarity")).distinct())
    a, b = (cells.select(*[F.col(c).alias(c + x) for c in cells.columns]) for x in "12")
    fits = F.when(F.col("rule1") == 3, F.col("part1") == F.col("part2")).otherwise((F.col("part1") != F.col("part2")) & (F.col("similarity") > 0.97))
    couples = materialize(names.join(a, "s1").join(b, "s2").filter((F.col("rule1") == F.col("rule2")) & fits))
    ends = ["rule1", "part1", "s1", "part2", "s2"]
    side = lambda x: members.select(*[F.col(c).alias(c + x) for c in cell], F.col("id").alias("id" + x), F.col("certain").alias("certain" + x))
    links = materialize(couples.select(*ends, "first2").join(side("1"), ["rule1", "part1", "s1"]).filter(F.col("id1") != F.col("first2.id")).select(
        *ends, F.col("id1").alias("id"), F.col("first2.id").alias("to"), F.arrays_overlap("certain1", "first2.certain").alias("sure")))

    # cells of several members where all links are sure and no key or date is common to all: is any other pair uncertain?
    shown = links.filter("not sure").select(*ends).distinct()
    unsure = couples.filter((F.col("n1") > 1) & (F.col("n2") > 1) & ((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("part1") <= F.col("part2")))))
    unsure = unsure.filter(~F.arrays_overlap("always1", "always2")).select(*ends).join(shown, ends, "left_anti")
    kinds = members.withColumn("certain", F.array_sort("certain")).groupBy(*cell, "certain").agg(F.min("id").alias("id"))
    kind = lambda x: kinds.select(*[F.col(c).alias(c + x) for c in (*cell, "id", "certain")])
    open_ = unsure.join(kind("1"), ["rule1", "part1", "s1"]).withColumn("rule2", F.col("rule1")).join(kind("2"), ["rule2", "part2", "s2"])
    open_ = open_.filter(~F.arrays_overlap("certain1", "certain2")).groupBy(*ends).agg(F.min(F.struct(F.col("id1").alias("id"), F.col("id2").alias("to"))).alias("x")).select("x.*")
    every = held.union(star(born, ["dob", "s"])).union(near).union(links.select("id", "to")).union(open_)
    return every.filter("id <> to").select(F.least("id", "to").alias("id_a"), F.greatest("id", "to").alias("id_b")).distinct()


RICHNESS = ("name", "aliases", "dob", "pob", "nationality", "gender", "identifiers", "addresses", "designation", "listing_reason", "listed_on", "programs", "source_url")


def richness() -> Column:
    """How many fields of an entity hold something."""
    return sum((F.when(~F.trim(F.coalesce(F.col(c), F.lit(""))).isin("", "[]", "{}"), 1).otherwise(0) for c in RICHNESS), F.lit(0))


def persons(entities: DataFrame, judged: DataFrame) -> DataFrame:
    """One row a person: representative (richest member, then smaller id), its members' sources, names and identifiers united, uncertainty.

    Sources are distinct (source, id); of names equal but for case, and of identifiers of one type and number, the first
    stays as it is written, in the order of ids and of the fields.  Entities in no merged pair stay persons of their own.
    """
    merged = judged.filter("rule > 0")
    comp = connected_components(merged.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    shaky = merged.join(comp, F.col("a_id") == F.col("id")).groupBy("component").agg(F.max(F.col("uncertain").cast("int")).alias("shaky"))
    e = entities.filter("id is not null").dropDuplicates(["id"]).withColumn("rich", richness())
    m = materialize(e.join(comp, "id", "left").select("id", "source", "name", "aliases", "identifiers", "rich", F.coalesce("component", "id").alias("person")))
    rep = m.groupBy("person").agg(F.min_by("id", F.struct(-F.col("rich"), "id")).alias("representative"), F.count("*").alias("members"), F.array_sort(F.collect_set(F.struct("source", "id"))).alias("all_sources"))

    def united(values: Column, key: Column, out: str) -> DataFrame:
        x = m.select("person", "id", F.posexplode(values).alias("pos", "v")).filter("v is not null").withColumn("k", key)
        first = x.groupBy("person", "k").agg(F.min(F.struct("id", "pos", "v")).alias("f"))
        return first.groupBy("person").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias(out))

    names = united(F.filter(F.concat(F.array("name"), items(F.col("aliases"))), lambda n: F.trim(n) != ""), F.lower("v"), "all_names")
    held = F.filter(id_list(F.col("identifiers")), lambda i: (F.trim(F.coalesce(i["type"], F.lit(""))) != "") & (F.trim(F.coalesce(i["value"], F.lit(""))) != ""))
    ids = united(held, F.concat(F.lower(F.trim("v.type")), F.lit(":"), F.lower(F.trim("v.value"))), "all_identifiers")
    return (
        rep.join(names, "person", "left").join(ids, "person", "left").join(shaky.withColumnRenamed("component", "person"), "person", "left")
        .select("person", "representative", "members", "all_sources", F.coalesce("all_names", F.array().cast("array<string>")).alias("all_names"), F.coalesce("all_identifiers", F.array().cast(IDENTIFIERS)).alias("all_identifiers"), (F.coalesce("shaky", F.lit(0)) > 0).alias("uncertain_merge"))
    )


def ranked_persons(found: DataFrame, scores: DataFrame) -> DataFrame:
    """``persons`` with the score of their representative (``id``, ``score``), best first; persons without one come last."""
    return found.join(scores.select(F.col("id").alias("representative"), "score"), "representative", "left").orderBy(F.desc_nulls_last("score"), "person")
