"""Bars from an event stream: late events within the watermark count, repeated ones do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count of each type and window; state goes once the watermark passes a window."""
    at = F.struct("ts", "event_id")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    return rows.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"),
    ).select("symbol", F.col("window.end").cast("timestamp_ntz").alias("eob"), "open", "high", "low", "close", "volume")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over all that is there, into a table of the session's memory, and return it."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
