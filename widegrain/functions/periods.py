"""Period keys of timestamps, by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(time: str | Column) -> Column:
    """YYYYMM."""
    return F.date_format(time, "yyyyMM")


def day_key(time: str | Column) -> Column:
    """YYYYMMDD."""
    return F.date_format(time, "yyyyMMdd")
