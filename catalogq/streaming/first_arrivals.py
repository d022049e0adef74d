"""First arrivals of a stream: each content once per watermark, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, content: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose content did not occur within ``delay`` before them; later rows are dropped with their state.

    The batch operator ``first_of_equal`` is exact over the whole table; this is its bounded counterpart for streams.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(content)


def arrivals_per_window(stream: DataFrame, event_time: str, window: str, delay: str, key: str) -> DataFrame:
    """Rows per time window and key; a window is told once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), key).agg(F.count(F.lit(1)).alias("n"))
