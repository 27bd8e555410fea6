"""What changed between full snapshots of a feed.

``diff_snapshots`` compares each good delivery of a source with the one before it
by a full outer join on the primary key over canonical row hashes: a missing side
is an addition or a removal, unequal hashes are a change.

Results at the edges: deliveries without metadata, or whose latest attempt is not
``ok``, do not count; the first that counts yields nothing; rows without id are
ignored; exact copies count once, and of unequal rows of one delivery with one id
the one loaded last holds (ties: the smaller hash).  Nulls, empty texts, blanks at
the ends, repeated blanks, the order of list items and the layout of JSON make no
change.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_FIELDS = ("name", "designation", "listed_on")
LIST_FIELDS = ("aliases", "dob", "nationality", "programs")
JSON_FIELDS = ("identifiers",)
_ITEM = "array<map<string,string>>"


def squeezed(c: Column) -> Column:
    """Text without blanks at the ends and with single blanks inside; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def canonical_list(c: Column) -> Column:
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), squeezed)
    return F.array_join(F.array_sort(F.filter(items, lambda x: x != "")), "|")


def canonical_json(c: Column) -> Column:
    """A JSON array of flat objects, its items and their keys in order; other text is squeezed only."""
    parsed = F.from_json(c, _ITEM)

    def item(m: Column) -> Column:
        pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), squeezed(e["value"])))
        return F.array_join(F.array_sort(F.filter(pairs, lambda p: ~p.endswith("="))), "\x1f")

    text = squeezed(c)
    return F.when(text.isin("", "[]", "null"), F.lit("")).when(
        parsed.isNotNull() & text.startswith("["), F.array_join(F.array_sort(F.transform(parsed, item)), "\x1e")
    ).otherwise(text)


def row_hash() -> Column:
    parts = [squeezed(F.col(c)) for c in TEXT_FIELDS] + [canonical_list(F.col(c)) for c in LIST_FIELDS] + [canonical_json(F.col(c)) for c in JSON_FIELDS]
    return F.sha2(F.concat_ws("\x1d", *parts), 256)


def good_deliveries(meta: DataFrame) -> DataFrame:
    """source, refresh_no, prev_no, same_file: the deliveries that count, each with the one before it."""
    last = meta.filter(F.col("source").isNotNull() & F.col("refresh_no").isNotNull()).groupBy("source", "refresh_no").agg(
        F.max_by(F.struct("status", "file_hash"), F.struct("last_fetched", "status")).alias("m")
    )
    w = Window.partitionBy("source").orderBy("refresh_no")
    return (
        last.filter(F.col("m.status") == "ok")
        .select("source", "refresh_no", F.lag("refresh_no").over(w).alias("prev_no"), F.lag("m.file_hash").over(w).alias("prev_hash"), F.col("m.file_hash").alias("file_hash"))
        .select("source", "refresh_no", "prev_no", F.coalesce((F.trim("file_hash") != "") & (F.col("file_hash") == F.col("prev_hash")), F.lit(False)).alias("same_file"))
    )


def diff_snapshots(snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """source, id, refresh_no, change (``added``, ``removed``, ``changed``) of every delivery that counts.

    The list of deliveries grows with the number of refreshes only and is joined to the rows by
    hash; rows are reduced to one hash each before the shuffle on (source, delivery, id).
    Deliveries with an equal file hash are equal files and are not compared.
    """
    good = good_deliveries(meta)
    key = ["source", "refresh_no", "id"]
    rows = (
        snapshots.filter(F.col("id").isNotNull() & F.col("source").isNotNull())
        .select(*key, "loaded_at", row_hash().alias("h"))
        .groupBy(*key)
        .agg(F.min_by("h", F.struct(-F.unix_micros(F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit(0).cast("timestamp"))), "h")).alias("h"))
    )
    pairs = good.filter(F.col("prev_no").isNotNull() & ~F.col("same_file"))
    new = rows.join(pairs.select("source", "refresh_no"), ["source", "refresh_no"]).select("source", "refresh_no", "id", F.col("h").alias("new_h"))
    old = rows.join(
        pairs.select("source", F.col("refresh_no").alias("to_no"), F.col("prev_no").alias("refresh_no")), ["source", "refresh_no"]
    ).select("source", F.col("to_no").alias("refresh_no"), "id", F.col("h").alias("old_h"))
    change = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(F.col("old_h") != F.col("new_h"), "changed")
    return new.join(old, key, "full_outer").select("source", "id", "refresh_no", change.alias("change")).filter("change is not null")
