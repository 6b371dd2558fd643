"""Time anchors and calendar buckets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month", "year")


def anchor(as_of: datetime | str | None) -> Column:
    """The moment a lookback counts from; the clock only when the caller names none."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(str(as_of)).cast("timestamp")


def since(as_of: datetime | str | None, *, days: int = 0, hours: int = 0) -> Column:
    return anchor(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))


def granularity_or_hour(granularity: str) -> str:
    return granularity if granularity in GRANULARITIES else "hour"


def bucket(granularity: str, moment: Column) -> Column:
    return F.date_trunc(granularity_or_hour(granularity), moment)


def epoch_date(seconds: Column) -> Column:
    """Epoch seconds -> calendar date in the session zone, which is UTC."""
    return F.to_date(F.timestamp_seconds(seconds))


def epoch_nanos(nanos: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))
