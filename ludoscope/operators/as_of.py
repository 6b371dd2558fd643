"""As-of join: what was in force at the time of each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def in_force(
    events: DataFrame,
    states: DataFrame,
    by: list[str],
    time: str,
    values: list[str],
    *,
    state_time: str | None = None,
    version: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """``events`` with the ``values`` of the newest state of the same key that is not after the event.

    A state counts from its own time on. Of states of one time the one with the largest ``version`` counts,
    or any without one. Before a key's first state, without a time, or without a key the values are NULL;
    a state whose values are NULL puts NULL in force. Every event stays, once, with all its columns.

    Events and states become one order that is cut into slices; a slice takes the last state from the slices
    before it. So neither a key with a large part of all rows is one task, nor is any event joined
    with more than one state.
    """
    usable = states.select(
        *by,
        F.col(state_time or time).alias("_time"),
        (F.col(version) if version else F.lit(None).cast("int")).alias("_version"),
        F.struct(*values).alias("_state"),
    )
    for column in (*by, "_time"):
        usable = usable.filter(F.col(column).isNotNull())
    asked = events.select(*by, F.col(time).alias("_time"), F.struct(*events.columns).alias("_event"))
    # A state comes before the events of its own time.
    both = usable.withColumn("_side", F.lit(0)).unionByName(
        asked.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    order = ["_time", "_side", "_version"]
    found = ordered.last_known(ordered.sliced(both, by, order, slices), by, order, {"_now": "_state"})
    return found.filter("_side = 1").select("_event.*", *[F.col(f"_now.{v}").alias(v) for v in values])
