"""Sliding windows over panes: one row per event, and the sums of panes instead of a copy per window.

Events are summed by pane, the length of a slide. A pane adds its sums to the windows from its own back to
the first that still covers it, so it comes in at one window and goes out at another: two rows, whatever the
number of windows over it. Sums of these changes along the order give each window's sums, in slices of the
order (``ordered``), so that a game with a third of all events is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.topics import check_topic
from . import ordered

LENGTH_SECONDS, SLIDE_SECONDS = 1800, 30


def _ones(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _sums(topic: str) -> dict[str, Column]:
    """What is summed of each event of a topic; exact, so that what goes out cancels what came in."""
    if check_topic(topic) == "purchases":
        net = numbers.net_hundredths(F.col("price_usd"), F.col("discount_pct"))
        return {"net": F.coalesce(net, F.lit(0)), "priced": _ones(net.isNotNull())}
    if topic == "reviews":
        rating = F.col("rating").cast("bigint")
        return {"ratings": F.coalesce(rating, F.lit(0)), "rated": _ones(rating.isNotNull()), "recommended": _ones(F.col("recommended"))}
    if topic == "sessions":
        ended = F.col("event_type") == "session_end"
        seconds = F.when(ended, F.col("duration_seconds").cast("bigint"))
        return {
            "num_starts": _ones(F.col("event_type") == "session_start"),
            "num_ends": _ones(ended),
            "seconds": F.coalesce(seconds, F.lit(0)),
            "timed": _ones(seconds.isNotNull()),
        }
    return {"num_added": _ones(F.col("action") == "added"), "num_removed": _ones(F.col("action") == "removed")}


def _measures(topic: str) -> list[Column]:
    """The topic's measures out of the sums, named as those of the tumbling windows."""

    def ratio(part: str, whole: str) -> Column:
        return F.col(part) / F.nullif(F.col(whole), F.lit(0).cast("bigint"))

    if topic == "purchases":
        net = F.when(F.col("priced") > 0, (F.col("net") / F.lit(100)).cast("double"))
        return [F.col("events").alias("num_purchases"), net.alias("revenue_net_usd")]
    if topic == "reviews":
        recommended = F.col("recommended") * F.lit(100.0) / F.col("events")
        return [F.col("events").alias("num_reviews"), ratio("ratings", "rated").alias("avg_rating"), recommended.alias("recommend_pct")]
    if topic == "sessions":
        return [F.col("num_starts"), F.col("num_ends"), ratio("seconds", "timed").alias("avg_duration_sec")]
    return [F.col("num_added"), F.col("num_removed"), (F.col("num_added") - F.col("num_removed")).alias("net_added")]


def sliding_windows(
    events: DataFrame, topic: str, *, length_seconds: int = LENGTH_SECONDS, slide_seconds: int = SLIDE_SECONDS, slices: int | None = None
) -> DataFrame:
    """Windows of ``length_seconds`` that start every ``slide_seconds``: ``window_start``, ``game_id``, measures.

    The measures are those of the tumbling windows. A window without events has no row. The length is a
    multiple of the slide; windows start at multiples of the slide since 1970. Events without a time are
    in no window.
    """
    if length_seconds % slide_seconds:
        raise ValueError(f"{length_seconds} seconds are not a multiple of {slide_seconds}")
    sums = {"events": F.lit(1).cast("bigint"), **_sums(topic)}
    over = length_seconds // slide_seconds
    pane = F.floor(F.unix_micros("event_time") / F.lit(slide_seconds * 1_000_000)).cast("bigint")
    panes = events.filter(F.col("event_time").isNotNull()).groupBy("game_id", pane.alias("pane")).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    comes = F.struct((F.col("pane") - (over - 1)).alias("window"), *[F.col(n) for n in sums])
    goes = F.struct((F.col("pane") + 1).alias("window"), *[(-F.col(n)).alias(n) for n in sums])
    changes = (
        panes.select("game_id", F.inline(F.array(comes, goes)))
        .groupBy("game_id", "window")
        .agg(*[F.sum(n).alias(n) for n in sums])
    )
    by, order = ["game_id"], ["window"]
    cut = ordered.sliced(changes, by, order, slices)
    summed = ordered.following(ordered.running_sum(cut, by, order, {n: n for n in sums}), by, order, "window", "until")
    # The sums hold from one change to the next; behind a game's last change nothing is left.
    windows = summed.filter(F.col("events") > 0).withColumn("window", F.explode(F.sequence("window", F.col("until") - 1)))
    start = F.timestamp_micros(F.col("window") * F.lit(slide_seconds * 1_000_000))
    return windows.select(start.alias("window_start"), "game_id", *_measures(topic))
