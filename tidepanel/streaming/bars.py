"""Bars from ticks, for batch tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str) -> DataFrame:
    """First and last value and the count of events per user and time bucket."""
    if dict(events.dtypes)["ts"] != "timestamp":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = events.groupBy(F.col("user_id").alias("code"), F.window("ts", width).alias("_w")).agg(
        (F.min_by("value", F.struct("ts", "event_id")) + 1).alias("open"),
        (F.max_by("value", F.struct("ts", "event_id")) + 1).alias("close"), F.count("*").cast("double").alias("volume"))
    return g.select("code", F.col("_w.start").cast("date").alias("date"), F.col("_w.start").alias("bar"), "open", "close", "volume")


def stream_bars(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark passed its end."""
    return event_bars(events.withWatermark("ts", delay), width)


def run_bars(events: DataFrame, width: str, delay: str, out: str, checkpoint: str) -> None:
    q = (stream_bars(events, width, delay).writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
