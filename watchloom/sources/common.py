"""The unified entry schema, and expression helpers for feed readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = {
    "id": "string", "source": "string", "list_name": "string", "names": "array<string>", "alias_quality": "array<string>", "dob": "array<string>",
    "dob_approximate": "boolean", "pob": "array<string>", "nationality": "array<string>", "gender": "string", "father_name": "string",
    "identifiers": "array<struct<type:string,value:string,country:string>>", "addresses": "array<string>", "designation": "string",
    "listing_reason": "string", "listed_on": "string", "programs": "array<string>", "source_url": "string", "raw": "string",
}


def entries(df: DataFrame, **cols: Column) -> DataFrame:
    """Project a feed onto the entry schema; columns not given are empty lists or null."""
    out = []
    for name, kind in ENTRY.items():
        c = cols.get(name)
        if c is None:
            c = F.array() if kind.startswith("array") else F.lit(False) if kind == "boolean" else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return df.select(*out).filter(F.size("names") > 0)


def t(c: Column | str) -> Column:
    """Trimmed text, empty where missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def some(*cs: Column) -> Column:
    """The non-empty ones of some texts, in order."""
    return F.filter(F.array(*cs), lambda x: x != "")


def joined(*cs: Column, sep: str = " ") -> Column:
    return F.array_join(some(*cs), sep)


def none_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def listed(c: Column | str) -> Column:
    """An array column, empty where missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array())


def texts(c: Column | str) -> Column:
    return F.filter(F.transform(listed(c), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def distinct_names(pairs: Column) -> Column:
    """Structs (n, q) of names without later repetitions that differ in case only."""
    return F.aggregate(
        F.filter(pairs, lambda p: p["n"] != ""),
        F.array().cast("array<struct<n:string,q:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda x: F.lower(x["n"]) == F.lower(p["n"])), acc).otherwise(F.array_append(acc, p)),
    )


def name(n: Column, q: Column | str) -> Column:
    return F.struct(n.cast("string").alias("n"), (F.lit(q) if isinstance(q, str) else q).cast("string").alias("q"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML file; namespaces are ignored, a record that can't be read gives nulls."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(schema).load(path)


def canonical_gender(c: Column) -> Column:
    g = F.lower(F.substring(F.trim(c), 1, 1))
    return F.when(g == "m", "male").when(g == "f", "female")
