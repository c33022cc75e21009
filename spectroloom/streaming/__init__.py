"""Streams of peaks: event-time windows, gap sessions and running monitors.

Batch operators of this package work on streams where Spark allows; these three need state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_intensity(peaks: DataFrame, at: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Sum, count and maximum of ``value`` in windows of event time; rows later than ``late`` are dropped by the watermark."""
    return peaks.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.max(value).alias("highest")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "total", "n", "highest")


def gap_sessions(peaks: DataFrame, at: str, keys: list[str], value: str, gap: str, late: str) -> DataFrame:
    """Chromatographic sessions: runs of points of a key without a gap of ``gap``."""
    return peaks.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "total", "n")


def distinct_in_time(rows: DataFrame, at: str, by: list[str], late: str) -> DataFrame:
    """The first row of each value of ``by``; state is kept for ``late`` of event time."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(by)
