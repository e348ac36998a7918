"""The monthly roll-up of a stream: an extension, as the batch roll-up has no streaming form elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, time: str, keys: list[str], measures: list[str], *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Sums and row count for each window and key; rows later than the watermark are left out."""
    window = F.window(F.col(time), width)
    grouped = events.withWatermark(time, late).groupBy(window, *keys).agg(*(F.sum(m).alias(m) for m in measures), F.count(F.lit(1)).alias("row_count"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *measures, "row_count")
