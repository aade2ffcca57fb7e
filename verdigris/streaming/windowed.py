"""Streams that need no custom state: tailing, progress, rates, sessions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.aggregates import chunk_progress

# How late a row may be.
LATENESS = "10 minutes"


def tail_events(stream: DataFrame, cursors: DataFrame | None = None, sequence: str = "sequence") -> DataFrame:
    """Events after each reader's cursor; afterwards the stream's checkpoint is the cursor.

    ``cursors``: (review_id, cursor), a static table joined to the stream.
    """
    if cursors is None:
        return stream
    joined = stream.join(cursors, "review_id", "left")
    return joined.where(F.col(sequence) > F.coalesce("cursor", F.lit(0))).select(*stream.columns)


def live_progress(stream: DataFrame, key: str = "review_id") -> DataFrame:
    """Chunk progress per review, updated with every batch (update mode)."""
    return chunk_progress(stream, key)


def windowed_rates(stream: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Error share and latency per endpoint and window of the attempts' start."""
    span = F.window("started_at", width, slide) if slide else F.window("started_at", width)
    grouped = stream.withWatermark("started_at", lateness).groupBy(span.alias("span"), "endpoint")
    return grouped.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.sum("latency_ms").alias("latency_ms"),
    ).select(
        "endpoint", F.col("span.start").alias("window_start"), "attempts", (F.col("errors") / F.col("attempts")).alias("error_rate"),
        (F.col("latency_ms") / F.col("attempts")).alias("mean_latency_ms"),
    )


def session_activity(stream: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions per user, closed by a gap without activity."""
    grouped = stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("span"), user)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        user, F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "events"
    )


def stream_dedupe(stream: DataFrame, keys: list[str], at: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """First row per key; state is kept only as long as duplicates may still arrive."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
