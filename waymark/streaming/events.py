"""A windowed view of a stream of events; an addition of this engine.

Works on streaming and on static DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begin, event_type, events, value): counts and sums of each window; rows later than ``late`` are left out of streams."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    sums = own.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return sums.select(F.col("window.start").alias("begin"), "event_type", "events", F.round("value", 4).alias("value"))
