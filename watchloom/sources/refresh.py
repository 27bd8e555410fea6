"""A refresh: the landed feeds become the current snapshot, and every attempt leaves a row of metadata."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..session import materialize
from .registry import FEEDS, flat_table

METADATA = "source string, last_fetched timestamp, entity_count bigint, file_hash string, status string, quality string"


def refresh(spark: SparkSession, landed: dict[str, str], live: store.SnapshotStore, metadata: DataFrame | None = None, at: datetime | None = None) -> tuple[str | None, DataFrame]:
    """(published version or None, metadata): read the feeds (source to path) one by one and publish their union.

    A feed that can't be read is an ``error`` row, and its entries stay as the current snapshot has them; a
    feed with fewer entries than its least number is loaded and marked ``low``.  Of equal ids, later feeds of the registry win.
    The hash is the content signature of the feed's ids.  Metadata keeps the latest attempt of every source.
    """
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    parts, rows = [], []
    for i, f in enumerate(f for f in FEEDS if f.source in landed):
        try:
            part = materialize(flat_table(f.read(spark, landed[f.source])))
            parts.append(part.withColumn("load_seq", F.lit(i)))
            signed = store.content_signature(part.select(F.lit(f.source).alias("source"), "id"), ["source"]).first()
            n = part.select("id").distinct().count()
            rows.append((f.source, at, n, signed["signature"] if signed else None, "ok", "low" if n < f.least else "ok"))
        except Exception:  # noqa: BLE001 - one feed must not stop the others
            rows.append((f.source, at, 0, None, "error", None))
    new = spark.createDataFrame(rows, METADATA)
    meta = new if metadata is None else store.upsert_metadata(metadata, new)
    if not parts:
        return None, meta
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = store.last_wins(out, ["id"], ["load_seq"]).drop("load_seq")
    try:
        kept = live.current()
    except Exception:  # noqa: BLE001 - nothing published yet
        kept = None
    if kept is not None:
        good = [r[0] for r in rows if r[4] == "ok"]
        rest = kept.select(*out.columns).filter(~F.coalesce(F.col("source").isin(*good), F.lit(False)))
        out = out.unionByName(rest.join(out.select("id"), "id", "left_anti").select(*out.columns))
    return live.publish(materialize(out)), meta
