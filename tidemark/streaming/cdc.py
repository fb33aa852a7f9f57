"""Change streams: micro-batches committed to a change log, and live state by stream.

Each micro-batch is one commit keyed by its batch id, so a batch that Spark repeats after
a failure is applied once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import ChangeLog


def commit_stream(changes: DataFrame, log: ChangeLog, checkpoint: str, vacuum_every: int = 0, keep: int = 1) -> StreamingQuery:
    """Applies a stream of changes (op, id, vector, ...) until its present end. With
    vacuum_every, history older than `keep` commits is reclaimed every so many batches."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        done = log.append(batch, batch_id=batch_id)
        if vacuum_every and (batch_id + 1) % vacuum_every == 0:
            log.vacuum(max(1, done.ts - keep))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def rejected(changes: DataFrame, clock: int) -> DataFrame:
    """Changes whose ts is not after the clock: refused, never reordered."""
    return changes.where(F.col("ts") <= clock)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra beyond commit order: events by event-time window and type, late rows dropped by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
