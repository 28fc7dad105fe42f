"""Event-time windows over the event stream (an extension: the engine this one is modelled on has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.merge import Snapshots
from siltwork.streaming.ingest import new_folder, parquet_stream


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) of each window; events later than the watermark are dropped by a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of all events that are there, by a stream that ends when it has read them.

    Update mode: only windows that changed are handed on and merged into the table, and state older than the watermark
    is let go. Files may come in any order of time, so the watermark is far behind.
    """
    rows = Snapshots(spark, new_folder(spark, "hourly"), "start timestamp_ntz, event_type string, n bigint, value double")
    stream = tumbling(parquet_stream(spark, folder, "events"), late="3650 days")

    def each(batch: DataFrame, _: int) -> None:
        rows.merge(batch, ["start", "event_type"])

    query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", new_folder(spark, "hourly-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.read()
