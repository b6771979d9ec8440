"""The live state of papers from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators.catalog import status_counts


def latest_status(events: DataFrame) -> DataFrame:
    """Per paper its newest status; ``events`` holds ``paper_id, event_id, ts, status``.  Batch or stream."""
    newest = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("paper_id").agg(newest.alias("_last")).select("paper_id", "_last.*")


def watch_status(events: DataFrame, write_batch, checkpoint: str, **trigger) -> StreamingQuery:
    """Sends the changed papers of each trigger to ``write_batch(rows, batch_id)``."""
    return (
        latest_status(events)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_counts(events: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Papers per latest status."""
    return status_counts(latest_status(events), labels)
