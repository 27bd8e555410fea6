"""The feeds: their readers, least counts, and the union into one entity table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import api_feeds, ofac, xml_feeds


@dataclass(frozen=True)
class Feed:
    source: str
    read: Callable[[SparkSession, str], DataFrame]
    least: int = 0


# Least numbers of entries below which a feed is taken for incomplete.
FEEDS = (
    Feed("ofac_sdn", lambda s, p: ofac.read_ofac(s, p, "ofac_sdn"), 6000), Feed("ofac_cons", lambda s, p: ofac.read_ofac(s, p, "ofac_cons")),
    Feed("un_consolidated", xml_feeds.read_un, 500), Feed("eu_fsf", xml_feeds.read_eu, 1000), Feed("uk_sanctions", xml_feeds.read_uk), Feed("ca_sema", xml_feeds.read_canada),
    Feed("ch_seco", xml_feeds.read_switzerland), Feed("australia_dfat", api_feeds.read_australia, 200), Feed("wikidata_peps", api_feeds.read_wikidata, 500),
    Feed("us_congress", api_feeds.read_congress, 400), Feed("uk_parliament", api_feeds.read_uk_parliament, 600), Feed("eu_parliament", xml_feeds.read_eu_parliament, 600),
    Feed("fbi_wanted", api_feeds.read_fbi, 20),
)


def flat_table(entries: DataFrame) -> DataFrame:
    """Entries as the flat entity table: ``|`` lists, JSON documents, Latin and ASCII names, phonetic codes."""
    bar = lambda c: F.array_join(c, "|")
    name = F.get("names", F.lit(0))
    plain = entries.withColumn("name", name).withColumn("name_latin", text.composed("name")).withColumn("name_ascii", text.ascii_only("name"))
    letters = F.regexp_replace("name_ascii", r"[^A-Za-z\s]", "")
    return plain.select(
        "id", "source", "list_name", "name", "name_latin", "name_ascii", bar(F.slice("names", F.lit(2), F.size("names"))).alias("aliases"), text.metaphone(letters).alias("phonetic_primary"), text.soundex_words(letters).alias("phonetic_alt"),
        bar("dob").alias("dob"), F.col("dob_approximate").cast("int").alias("dob_approximate"), bar("pob").alias("pob"), bar("nationality").alias("nationality"), "gender", F.to_json("identifiers").alias("identifiers"),
        bar("addresses").alias("addresses"), "designation", "listing_reason", "listed_on", bar("programs").alias("programs"), "source_url", F.coalesce("raw", F.lit("{}")).alias("raw_json"),
    )


def read_all(spark: SparkSession, landed: dict[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the landed feeds (source to path) and the sources that failed, with why; later feeds overwrite equal ids."""
    from ..operators.store import last_wins

    out, failed = None, {}
    for i, f in enumerate(FEEDS):
        if f.source in landed:
            try:
                df = f.read(spark, landed[f.source]).withColumn("load_seq", F.lit(i))
                _ = df.schema
                out = df if out is None else out.unionByName(df)
            except Exception as e:  # noqa: BLE001 - one feed must not stop the others
                failed[f.source] = str(e)[:200]
    return (None if out is None else last_wins(out, ["id"], ["load_seq"]).drop("load_seq")), failed
