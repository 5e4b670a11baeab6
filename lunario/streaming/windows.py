"""The bucket aggregation over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of a size that never changes; weeks start on Monday, four days after 1970-01-01.
UNITS = {"h": ("hours", "0 seconds"), "d": ("days", "0 seconds"), "w": ("weeks", "4 days")}


def streaming_buckets(stream: DataFrame, keys: Sequence[str], time: str, size: int, granularity: str, aggregates: Sequence[Column], lateness: str = "1 day") -> DataFrame:
    """Aggregates by key and tumbling bucket, of a stream or a table; rows later than ``lateness`` are dropped by a stream.

    Hours, days and weeks only: months and years have no fixed length. The grid starts at the epoch (weeks: its first
    Monday), since a stream has no least time. ``bucket_end`` is inclusive.
    """
    letter = granularity[:1]
    if letter not in UNITS:
        raise ValueError(f"Granularity {granularity} is not supported for streams")
    unit, start = UNITS[letter]
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("_t", lateness)
    grouped = rows.groupBy(*keys, F.window("_t", f"{size} {unit}", startTime=start).alias("_w")).agg(*aggregates)
    edges = [F.col("_w.start").cast("timestamp_ntz").alias("bucket_start"), (F.col("_w.end") - F.expr("interval 1 second")).cast("timestamp_ntz").alias("bucket_end")]
    return grouped.select(*keys, *edges, *[c for c in grouped.columns if c not in {*keys, "_w"}])
