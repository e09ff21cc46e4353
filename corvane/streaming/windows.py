"""Structured Streaming forms of sessions and rates; stateful.py has quotas and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after an idle gap; the end is the last sign of life."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, idle), user)
    return g.agg(F.min(ts).alias("login_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("beats")).drop("session_window")


def rate_stream(events: DataFrame, ts: str = "ts", width: str = "1 minute", tokens: str = "tokens", late: str = "2 minutes") -> DataFrame:
    """Requests and tokens of each tumbling window."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width))
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).select(F.col("window.start").alias("start"), "requests", "tokens")
