"""Event-time windows on streams or batches of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, at: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are dropped, as the state must end."""
    rows = events.withWatermark(at, late).groupBy(*keys, F.window(at, width, slide) if slide else F.window(at, width))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; the checkpoint makes a restarted run go on where this one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
