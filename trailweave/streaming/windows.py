"""The spatial windows' analogues on streams: tumbling windows, sessions by gap, merges by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of events (ts, event_type, value) by window; works on batches and, with the watermark, on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    g = timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Runs of a user's events that no gap splits."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    g = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def merge_batches(stream: DataFrame, key: str, order: str, path: str, staging: str, keep: int = 2):
    """Starts a query that keeps the newest row of each key by ``order`` in a versioned table at ``path``.

    A batch that is run again changes nothing, numbers may be skipped, and all but the last ``keep`` versions are removed.
    """
    from ..sources.versions import Versions

    def merge(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path)
        table.merge(batch, [key], F.col(order), number)
        table.clean(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", staging).start()
