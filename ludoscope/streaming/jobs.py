"""The eight standing queries: four windowed aggregates and four raw copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.unique import unique_events
from ..operators.windows import WATERMARK, WINDOW, aggregate_windows
from ..sources.topics import TOPICS, check_topic
from . import sinks

AGGREGATE_TRIGGER = {"processingTime": "15 seconds"}
RAW_TRIGGER = {"processingTime": "30 seconds"}
# Names under which the aggregates run.
QUERY_NAMES = {
    "purchases": "purchases_revenue",
    "reviews": "reviews_sentiment",
    "sessions": "sessions_activity",
    "wishlist": "wishlist_net",
}


def start_aggregate(
    events: DataFrame,
    topic: str,
    root: str,
    checkpoints: str,
    *,
    window: str = WINDOW,
    watermark: str = WATERMARK,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Windowed aggregate of a topic, in update mode, into the history, and from its files into the live state."""
    name = QUERY_NAMES[check_topic(topic)]
    windows = aggregate_windows(events, topic, window=window, watermark=watermark)
    write_history = sinks.history_writer(root, topic)

    def take(batch: DataFrame, batch_id: int) -> None:
        write_history(batch, batch_id)
        sinks.refresh_live(batch.sparkSession, root, topic, batch_id)

    return (
        windows.writeStream.queryName(name)
        .foreachBatch(take)
        .option("checkpointLocation", f"{checkpoints}/{name}")
        .outputMode("update")
        .trigger(**(trigger or AGGREGATE_TRIGGER))
        .start()
    )


def start_raw(
    events: DataFrame,
    topic: str,
    root: str,
    checkpoints: str,
    *,
    trigger: dict | None = None,
    unique_within: str | None = None,
) -> StreamingQuery:
    """Copy of a topic's events into dated folders; unreadable messages are set apart.

    With ``unique_within``, how late an event may be, events delivered again are left out. Late ones and all
    but one of the unreadable messages of that time are then left out too.
    """
    name = f"raw_events_{check_topic(topic)}"
    if unique_within:
        events = unique_events(events, watermark=unique_within)
    return (
        events.writeStream.queryName(name)
        .foreachBatch(sinks.raw_writer(root, topic))
        .option("checkpointLocation", f"{checkpoints}/{name}")
        .outputMode("append")
        .trigger(**(trigger or RAW_TRIGGER))
        .start()
    )


def start_all(
    read: Callable[[str], DataFrame],
    root: str,
    checkpoints: str,
    *,
    aggregate_trigger: dict | None = None,
    raw_trigger: dict | None = None,
    **window_options,
) -> list[StreamingQuery]:
    """Start the eight queries; ``read(topic)`` gives the parsed stream of a topic."""
    running = [
        start_aggregate(read(t), t, root, checkpoints, trigger=aggregate_trigger, **window_options)
        for t in TOPICS
    ]
    running += [start_raw(read(t), t, root, checkpoints, trigger=raw_trigger) for t in TOPICS]
    return running


def run_until_any_ends(spark: SparkSession) -> None:
    spark.streams.awaitAnyTermination()
