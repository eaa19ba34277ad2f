"""Windowed counts of events, the same plan for a table and for a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window and type: count and sum. On a stream, rows later than the watermark go and
    the state of closed windows with them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    g = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """A user's runs of events less than the gap apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    g = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("s.start").alias("start"), "n")


def sliding_counts(events: DataFrame, length: str = "2 days", step: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by overlapping windows and type: count and sum."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    g = timed.groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


VISITS = "user_id long, visits long, last_type string, repeated long"
SEEN = "types array<string>, visits long, last_type string, repeated long"


def running_visits(events: DataFrame, idle: str = "1 day") -> DataFrame:
    """A user's visits so far on a stream of events (ts, user_id, event_type): how many, the last type, and how many were to a type seen
    before. State is the types a user has been to; it goes after a day, in event time, without events."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        types, visits, last, repeated = state.get if state.exists else ([], 0, "", 0)
        seen = set(types)
        for rows in batches:
            for t in rows.sort_values("ts")["event_type"]:
                visits, last, repeated = visits + 1, t, repeated + (t in seen)
                seen.add(t)
        state.update((sorted(seen), visits, last, repeated))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)
        yield pd.DataFrame([(key[0], visits, last, repeated)], columns=["user_id", "visits", "last_type", "repeated"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    return timed.groupBy("user_id").applyInPandasWithState(update, VISITS, SEEN, "update", "EventTimeTimeout")
