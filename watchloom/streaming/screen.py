"""Screening a stream of subjects against a static watchlist, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.screening import screen


def screen_stream(subjects: DataFrame, entities: DataFrame, path: str, checkpoint: str, late: str = "1 hour", **tuning: float) -> StreamingQuery:
    """Append the matches of every new subject to ``path``; repeated requests within ``late`` are screened once.

    ``subjects``: streaming, subject, name, created_at.  A batch that is retried overwrites its own folder.
    """
    once = subjects.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["subject"])

    def run(batch: DataFrame, n: int) -> None:
        screen(batch.select("subject", "name"), entities, **tuning).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
