"""Job states and events as streams.

latest_states keeps one row of state per job (the newest change by event time, then by sequence); counts are windowed with
a watermark, so state older than the lateness allowed is forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_states(changes: DataFrame, key: str, state: str, ts: str, seq: str) -> DataFrame:
    """key, state, ts, seq: write in update mode. Equal on streams and tables; a null time counts as oldest."""
    newest = F.max_by(F.struct(state, ts, seq), F.struct(F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(0))), F.col(seq)))
    return changes.groupBy(key).agg(newest.alias("_r")).select(key, f"_r.{state}", f"_r.{ts}", f"_r.{seq}")


def event_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, kind, n per tumbling window; rows later than late behind the newest are left out by the watermark."""
    seen = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return seen.groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes events as JSON lines, each row once, and stops when what is there has been written."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
