"""Windowed aggregates over event streams; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, late: str = "1 hour") -> DataFrame:
    """A stream of Parquet files with a watermark on ts, which must be a timestamp with a zone for that."""
    return with_watermark(spark.readStream.schema(schema).parquet(folder), late)


def with_watermark(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling, or with slide sliding, window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
