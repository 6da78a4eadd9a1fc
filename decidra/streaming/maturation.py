"""Structured Streaming: labels that mature with the watermark, and volume by day.

These go beyond batch tables: the same semantics on arriving rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matured_labels(decisions: DataFrame, events: DataFrame, *, key: str, decided_at: str, event_at: str, horizon: str, lateness: str = "1 hour") -> DataFrame:
    """Each decision with 1 if its key has an event in [decision, decision + horizon], else 0 once the watermark has passed that.

    A left outer interval join of two streams: state is kept for the horizon and lateness only.
    """
    left = decisions.withWatermark(decided_at, lateness).alias("d")
    right = events.select(F.col(key).alias("_key"), F.col(event_at).alias("_event_at")).withWatermark("_event_at", lateness)
    inside = (F.col(f"d.{key}") == F.col("_key")) & (F.col("_event_at") >= F.col(f"d.{decided_at}")) & (F.col("_event_at") <= F.col(f"d.{decided_at}") + F.expr(f"INTERVAL {horizon}"))
    joined = left.join(right, inside, "left_outer")
    return joined.select("d.*", F.col("_event_at").alias("event_at"), F.col("_event_at").isNotNull().cast("int").alias("label"))


def daily_volume(rows: DataFrame, *, time: str, lateness: str = "1 day") -> DataFrame:
    """(day, n), closed once the watermark passes the day."""
    return rows.withWatermark(time, lateness).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def first_seen(rows: DataFrame, *, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """The first row of each key; state of keys older than the watermark is dropped."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
