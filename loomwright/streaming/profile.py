"""Key profiles over streams: the counts of ``operators.profile`` in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(rows: DataFrame, key: Column, size: Column, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, key, n, bytes) of each window; rows later than ``delay`` behind the latest are left out.

    The state holds one row for each key of an open window. A batch table gives the same rows.
    """
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, delay)
    counted = rows.groupBy(F.window(time, window).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
    return counted.select(F.col("w.start").alias("start"), "key", "n", "bytes")
