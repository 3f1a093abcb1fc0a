"""An extension: the call trace as a stream, rolled up by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def rollup(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Calls and mean latency by role and window; repeated event ids within the watermark count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("role")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 6).alias("mean_latency")).select(F.col("w.start").alias("start"), "role", "calls", "mean_latency")
