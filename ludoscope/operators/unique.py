"""Events that are delivered several times, counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_events(
    events: DataFrame, *, key: str = "event_id", time: str = "event_time", watermark: str | None = None
) -> DataFrame:
    """Each id once; events without an id stay as they are in a batch and are one in a stream.

    A stream needs ``watermark``, how late an event may be. Its state is the ids of that time: a copy has the
    time of its original, so when the id is forgotten the copy is late and is dropped for that. In a batch
    the copy with the earliest time counts, and of those any.
    """
    if watermark:
        return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c not in (key, time)]
    first = F.min_by(F.struct(time, *rest), F.coalesce(time, F.lit("9999-12-31").cast("timestamp"))).alias("first")
    known = events.filter(F.col(key).isNotNull())
    one = known.groupBy(key).agg(first).select(key, f"first.{time}", *[f"first.{c}" for c in rest])
    return one.select(*events.columns).unionByName(events.filter(F.col(key).isNull()))
