"""Monthly activity from a stream: watermarked counts per month, fed to the same series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import month_index


def monthly_views(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """(keys, month, views) of an event stream or table; late rows beyond ``delay`` are dropped in a stream.

    State is one counter per key and day within the watermark; days are summed to months by ``to_months``.
    """
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(*keys, F.window(ts, "1 day").alias("_w")).agg(F.count("*").alias("views")).select(*keys, F.col("_w.start").alias("day"), "views")


def to_months(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.groupBy(*keys, month_index(F.col("day")).alias("month")).agg(F.sum("views").alias("views"))
