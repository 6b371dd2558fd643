"""Sketches that are stored by short windows and merged into longer ones, without reading events again.

A quantile sketch (KLL) answers with a value whose rank is off by RANK_ERROR of the count at most, in 99
of 100 cases, a distinct count (HyperLogLog) is off by DISTINCT_ERROR in two of three; merging costs neither
any accuracy. A sketch is some kilobytes at most, whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_SIZE, RANK_ERROR = 400, 0.01
HLL_BITS, DISTINCT_ERROR = 14, 0.007
QUANTILES = (0.50, 0.95, 0.99)


def latency_sketches(log: DataFrame, *by: str, window: str = "1 minute") -> DataFrame:
    """``window_start``, ``by`` and a ``sketch`` of the durations; requests without a duration are left out."""
    timed = log.filter(F.col("duration_s").isNotNull())
    start = F.window("ts", window).start.alias("window_start")
    return timed.groupBy(start, *by).agg(F.kll_sketch_agg_double("duration_s", KLL_SIZE).alias("sketch"))


def merged_latency(sketches: DataFrame, *by: str, window: str = "1 day") -> DataFrame:
    """Sketches of longer windows out of stored shorter ones."""
    start = F.window("window_start", window).start.alias("window_start")
    return sketches.groupBy(start, *by).agg(F.kll_merge_agg_double("sketch", KLL_SIZE).alias("sketch"))


def latency_of(sketches: DataFrame, *by: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``requests`` and the quantiles of each sketch."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles]
    return sketches.select("window_start", *by, F.kll_sketch_get_n_double("sketch").alias("requests"), *found)


def user_sketches(events: DataFrame, *by: str, window: str = "1 hour", user: str = "user_id") -> DataFrame:
    """``window_start``, ``by`` and a ``sketch`` of the distinct users; NULL users are none."""
    start = F.window("event_time", window).start.alias("window_start")
    known = events.filter(F.col(user).isNotNull())
    return known.groupBy(start, *by).agg(F.hll_sketch_agg(user, HLL_BITS).alias("sketch"))


def merged_users(sketches: DataFrame, *by: str, span: str) -> DataFrame:
    """Sketches of days, weeks or months (``date_trunc``) out of stored shorter ones, or over fewer groups."""
    return sketches.groupBy(F.date_trunc(span, "window_start").alias("window_start"), *by).agg(
        F.hll_union_agg("sketch").alias("sketch")
    )


def users_of(sketches: DataFrame, *by: str) -> DataFrame:
    estimate: Column = F.hll_sketch_estimate("sketch")
    return sketches.select("window_start", *by, estimate.alias("users"))
