"""Live state: the newest window per (topic, game), gone once it has not been updated for a while."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..sources.topics import check_topic

# Fixed value: seconds after which an entry that is not updated disappears.
TTL_SECONDS = 600


def newest_per_key(windows: DataFrame, topic: str, *, key: str = "game_id") -> DataFrame:
    """One row per key from rows with ``window_start`` and ``updated_at``; NULL keys are skipped.

    Expects one row per (window, key), as ``latest_version`` leaves them.
    """
    rest = [c for c in windows.columns if c not in (key, "window_start")]
    newest = (
        windows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.max("window_start").alias("window_start"),
            *[F.max_by(c, "window_start").alias(c) for c in rest],
        )
    )
    return newest.select(F.lit(check_topic(topic)).alias("topic"), key, "window_start", *rest)


def live_state(
    windows: dict[str, DataFrame],
    *,
    as_of: datetime | str | None = None,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """State of all topics in one table; a measure of another topic is NULL."""
    oldest = times.anchor(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    state = None
    for topic, rows in windows.items():
        # The age filter comes first, so old files are pruned before anything is grouped.
        fresh = rows.filter(F.col("updated_at") > oldest)
        one = newest_per_key(fresh, topic)
        state = one if state is None else state.unionByName(one, allowMissingColumns=True)
    return state


def as_hash(state: DataFrame) -> DataFrame:
    """The state as key and map of text fields without NULLs, the shape of a key-value store."""
    fields = [c for c in state.columns if c != "topic"]
    entries = F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in fields])
    present = F.map_from_entries(F.filter(entries, lambda e: e["col2"].isNotNull()))
    key = F.concat_ws(":", F.lit("stat"), "topic", F.col("game_id").cast("string"))
    return state.select(key.alias("key"), present.alias("data"))


def live_stat(state: DataFrame, topic: str, game_id: int) -> DataFrame:
    return state.filter((F.col("topic") == check_topic(topic)) & (F.col("game_id") == game_id))


def live_all(state: DataFrame, topic: str | None = None, limit: int = 100) -> DataFrame:
    if topic:
        state = state.filter(F.col("topic") == check_topic(topic))
    return state.orderBy("topic", "game_id").limit(limit)
