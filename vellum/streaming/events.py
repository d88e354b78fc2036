"""Structured Streaming over event tables: an extension beside the batch operators, which have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files that match in ``folder``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows; events later than the watermark are dropped when run as a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = stamped.withWatermark(time, late) if events.isStreaming else stamped
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def session_counts(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user, session_start, session_end, n) of sessions that a gap ends."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = stamped.withWatermark(time, late) if events.isStreaming else stamped
    sessions = rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
