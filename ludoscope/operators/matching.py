"""Events that another event follows within a time: purchases and the reviews that come after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WITHIN_DAYS = 7
PLAYER = ("user_id", "game_id")


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def followed_by(
    first: DataFrame,
    second: DataFrame,
    *,
    names: tuple[str, str] = ("purchase", "review"),
    by: tuple[str, ...] = PLAYER,
    time: str = "event_time",
    within_days: float = WITHIN_DAYS,
    watermarks: tuple[str, str] | None = None,
) -> DataFrame:
    """Each row of ``first`` with each row of ``second`` of the same key that comes within the time, or with none.

    The second event is at the first one's time or later, by ``within_days`` at most. Columns carry the
    names of their sides. A row of ``first`` that nothing follows stays once, the other side's columns NULL;
    so does a row without time or key.

    For streams ``watermarks`` say how late either side may be. Both sides are kept as state as long as a match
    can still come, and a first event that nothing followed is given out when the time has passed on both
    sides. In a batch matched and unmatched rows are planned apart, as adaptive execution splits a key with
    very many rows on both sides of an inner join only.
    """
    a, b = names
    if watermarks:
        first, second = first.withWatermark(time, watermarks[0]), second.withWatermark(time, watermarks[1])
    left, right = _named(first, a), _named(second, b)
    at, then = F.col(f"{a}_{time}"), F.col(f"{b}_{time}")
    latest = at + F.expr(f"INTERVAL '{round(within_days * 1440)}' MINUTE")
    meets: Column = (then >= at) & (then <= latest)
    for column in by:
        meets = (F.col(f"{a}_{column}") == F.col(f"{b}_{column}")) & meets
    if watermarks:
        return left.join(right, meets, "left_outer")
    matched = left.join(right, meets, "inner")
    return matched.unionByName(left.join(right, meets, "left_anti"), allowMissingColumns=True)
