"""Windowed rates over a stream of events; the same plan runs on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", bad: str = "error") -> DataFrame:
    """Per tumbling window: events, bad ones, their share and the mean value; rows later than ``late`` are left out of streams."""
    # A watermark needs an instant; a time without zone is read in the session's.
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("event_type") == bad, 1)).alias("bad"), F.avg("value").alias("mean")
    )
    return grouped.select(F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("share"), F.round("mean", 6).alias("mean"))


def watch(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the rates of a folder's Parquet files as Parquet in ``out``.

    A window is written once, when the watermark has passed its end; its state goes then, and rows that come
    later are left out.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    return rates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
