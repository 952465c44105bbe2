"""Streaming forms of active windows and event counts, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_windows(events: DataFrame, keys: list[str], ts: str = "ts", gap_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(keys, start, end, events): runs as :func:`operators.sequence.active_windows` finds them, closed once the watermark has passed their end.

    A session window ends a gap after its last event and joins at exactly the gap, so its bare end
    is that end less the gap.
    """
    w = F.session_window(ts, f"{gap_minutes} minutes")
    g = events.withWatermark(ts, late).groupBy(*keys, w).agg(F.count("*").alias("events"))
    return g.select(*keys, F.col("session_window.start").alias("start"), (F.col("session_window.end") - F.expr(f"INTERVAL {gap_minutes} MINUTES")).alias("end"), "events")


def hourly_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("hour"), key, "n")
