"""Event streams: the same functions serve batch and streaming frames.

State is bounded by the watermark: windows and sessions that it has passed are
emitted and forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``start, tet, n, mean_v``: multi-unit activity in windows of event time. ``events`` has ``at, tet, v``."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    out = timed.groupBy(F.window("at", width), "tet").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"))
    return out.select(F.col("window.start").alias("start"), "tet", "n", "mean_v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``cell, start, end, n``: runs of one cell's events with gaps below ``gap``; ``end`` is the last event plus the gap."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("at", gap).alias("s"), "cell").agg(F.count("*").alias("n"))
    return out.select("cell", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
