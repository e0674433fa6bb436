"""Windows over events, for batches and for streams alike (an extension beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late and events.isStreaming else timed


def tumbling(events: DataFrame, width: str, late: str | None = "10 minutes") -> DataFrame:
    """Events per type in windows of ``width``; in a stream, events later than ``late`` behind the latest are dropped."""
    per = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


def sessions(events: DataFrame, gap: str, late: str | None = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    per = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n_events")


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
