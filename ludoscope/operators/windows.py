"""Per-game event windows. Batch and streaming plans use the same function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.topics import check_topic

# Window length and allowed lateness of the streaming aggregates.
WINDOW = "30 seconds"
WATERMARK = "10 seconds"


def _ones(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def measures(topic: str) -> list[Column]:
    """Aggregates of one topic; all of them combine on the map side."""
    if check_topic(topic) == "purchases":
        revenue = numbers.net_sum(F.col("price_usd"), F.col("discount_pct"))
        return [
            F.count(F.lit(1)).alias("num_purchases"),
            revenue.alias("revenue_net_usd"),
        ]
    if topic == "reviews":
        return [
            F.count(F.lit(1)).alias("num_reviews"),
            F.avg("rating").alias("avg_rating"),
            (_ones(F.col("recommended")) * F.lit(100.0) / F.count(F.lit(1))).alias("recommend_pct"),
        ]
    if topic == "sessions":
        ended = F.col("event_type") == "session_end"
        return [
            _ones(F.col("event_type") == "session_start").alias("num_starts"),
            _ones(ended).alias("num_ends"),
            F.avg(F.when(ended, F.col("duration_seconds"))).alias("avg_duration_sec"),
        ]
    added, removed = _ones(F.col("action") == "added"), _ones(F.col("action") == "removed")
    return [
        added.alias("num_added"),
        removed.alias("num_removed"),
        (added - removed).alias("net_added"),
    ]


def aggregate_windows(
    events: DataFrame,
    topic: str,
    *,
    window: str = WINDOW,
    watermark: str | None = None,
) -> DataFrame:
    """Tumbling windows per game: ``window_start``, ``game_id`` and the topic's measures.

    A stream needs ``watermark``; a batch reads whole windows and ignores lateness. Rows without
    an event time belong to no window.
    """
    if watermark:
        events = events.withWatermark("event_time", watermark)
    spans = events.groupBy(F.window("event_time", window).alias("span"), "game_id").agg(*measures(topic))
    return spans.select(F.col("span.start").alias("window_start"), "game_id", *spans.columns[2:])


def latest_version(versions: DataFrame, *, version: str = "batch_id") -> DataFrame:
    """Keep the newest row per (window, game) of a history written in update mode.

    A streaming aggregate re-emits a window whenever it grows; summing all emissions would count
    events several times.
    """
    key = ["window_start", "game_id"]
    rest = [c for c in versions.columns if c not in (*key, version)]
    # All columns come from one row, also among equal versions.
    newest = F.max(F.struct(version, *rest)).alias("newest")
    return versions.groupBy(*key).agg(newest).select(*key, *[f"newest.{c}" for c in rest])
