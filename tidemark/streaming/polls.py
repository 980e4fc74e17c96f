"""The same state from a stream of polls: Structured Streaming in place of a cron job.

Late rows are allowed for ``delay``; state older than the watermark is let go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums for each window and type."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, size: str = "3 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "event_type", "n")
    )


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """A user's visits: events less than ``gap`` apart."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
    )


def first_sights(events: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """Each key's first row within the watermark: new arrivals, once."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops, like one run of a scheduled job."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Keyed state by micro-batch: each batch's aggregate is one immutable part, keyed by batch id and so
    written once however often a batch is retried; readers merge parts with ``merged``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*key).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("times"), F.max_by("value", "ts").alias("last_value")
        )
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(parts: DataFrame, key: list[str]) -> DataFrame:
    return parts.groupBy(*key).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("times").alias("times"), F.max_by("last_value", "last_ts").alias("last_value")
    )
