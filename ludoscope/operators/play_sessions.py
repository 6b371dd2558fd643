"""Play sessions: events of a player in a game that follow each other within a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_SECONDS = 1800
PLAYER = ("user_id", "game_id")


def _counts() -> dict[str, Column]:
    kinds = {"num_starts": "session_start", "num_heartbeats": "session_heartbeat", "num_ends": "session_end"}
    return {
        "num_events": F.count(F.lit(1)),
        **{name: F.count_if(F.coalesce(F.col("event_type") == kind, F.lit(False))) for name, kind in kinds.items()},
    }


def play_sessions(
    events: DataFrame, *, gap_seconds: int = GAP_SECONDS, by: tuple[str, ...] = PLAYER, watermark: str | None = None
) -> DataFrame:
    """One row per session: first and last event, seconds between them, and its starts, heartbeats and ends.

    Two events of a player and game are of one session if no more than ``gap_seconds`` lie between them, or
    if events between them connect them so. An event without a time belongs to no session; a NULL player
    or game is one of its own.

    A stream needs ``watermark``, and a session is complete when the watermark has passed its gap: an
    event that arrives before can still join two sessions. In a batch the events of one gap's length of
    time are first reduced to one row, on the map side too, since they are of one session in any case; so
    what a player with a third of all events sends on follows the time, not the events.
    """
    timed = events.filter(F.col("event_time").isNotNull())
    if watermark:
        span = F.session_window("event_time", f"{gap_seconds} seconds")
        found = timed.withWatermark("event_time", watermark).groupBy(*by, span).agg(
            F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), *[c.alias(n) for n, c in _counts().items()]
        )
    else:
        pane = F.window("event_time", f"{gap_seconds} seconds")
        panes = timed.groupBy(*by, pane).agg(
            F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), *[c.alias(n) for n, c in _counts().items()]
        )
        micros = F.unix_micros("last_event") - F.unix_micros("first_event") + F.lit(gap_seconds * 1_000_000)
        span = F.session_window("first_event", F.concat(micros.cast("string"), F.lit(" microseconds")))
        found = panes.groupBy(*by, span).agg(
            F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), *[F.sum(n).alias(n) for n in _counts()]
        )
    seconds = (F.unix_micros("last_event") - F.unix_micros("first_event")) / F.lit(1e6)
    return found.select(
        *by,
        F.col("first_event").alias("session_start"),
        F.col("last_event").alias("session_end"),
        seconds.alias("played_seconds"),
        *_counts(),
        (F.col("num_ends") > 0).alias("completed"),
    )
