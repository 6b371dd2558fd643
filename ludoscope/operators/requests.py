"""Roll-ups of a request log: ``ts``, ``handler``, ``status``, ``duration_s``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum, sliced

RATE_WINDOW = "1 minute"
QUALITY_WINDOW = "5 minutes"
QUANTILES = (0.50, 0.95, 0.99)
# Upper bounds of the latency histogram in seconds. A last bucket ends at the group's largest value.
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0,
)


def total_requests(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"))


def _per_window(log: DataFrame, window: str, by: tuple[str, ...], *aggregates: Column, watermark=None):
    if watermark:
        log = log.withWatermark("ts", watermark)
    grouped = log.groupBy(F.window("ts", window).alias("span"), *by).agg(*aggregates)
    seconds = (F.unix_micros("span.end") - F.unix_micros("span.start")) / F.lit(1e6)
    return grouped.select(
        F.col("span.start").alias("window_start"), *grouped.columns[1:], seconds.alias("_seconds")
    )


def request_rate(
    log: DataFrame, *by: str, window: str = RATE_WINDOW, watermark: str | None = None
) -> DataFrame:
    """Requests per second in each window, overall or per ``handler`` / ``status``."""
    counted = _per_window(log, window, by, F.count(F.lit(1)).alias("requests"), watermark=watermark)
    rate = (F.col("requests") / F.col("_seconds")).alias("req_per_sec")
    return counted.select("window_start", *by, rate)


def error_rate(
    log: DataFrame, *, window: str = QUALITY_WINDOW, watermark: str | None = None
) -> DataFrame:
    """Share of 5xx answers in each window, and 5xx answers per second."""
    failed = F.count_if(F.col("status").between(500, 599))
    counted = _per_window(
        log,
        window,
        (),
        F.count(F.lit(1)).alias("requests"),
        failed.alias("failed"),
        watermark=watermark,
    )
    return counted.select(
        "window_start",
        "requests",
        (F.col("failed") / F.col("requests")).alias("error_rate"),
        (F.col("failed") / F.col("_seconds")).alias("errors_per_sec"),
    )


def latency_quantiles(
    log: DataFrame,
    *by: str,
    window: str = QUALITY_WINDOW,
    quantiles: tuple[float, ...] = QUANTILES,
    bounds: tuple[float, ...] = LATENCY_BOUNDS,
    watermark: str | None = None,
) -> DataFrame:
    """Quantiles read off a latency histogram, interpolated inside the bucket.

    The state of a group is one count per bucket, however many requests it holds.
    """
    bound_counts = [
        F.count_if(F.col("duration_s") <= bound).cast("double").alias(f"le_{i}")
        for i, bound in enumerate(bounds)
    ]
    counted = _per_window(
        log,
        window,
        by,
        F.count("duration_s").alias("requests"),
        F.max("duration_s").alias("most"),
        *bound_counts,
        watermark=watermark,
    )
    return counted.select(
        "window_start",
        *by,
        "requests",
        *[_histogram_quantile(q, bounds).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def _histogram_quantile(q: float, bounds: tuple[float, ...]) -> Column:
    wanted = F.col("requests") * F.lit(q)
    chain = F.when(F.col("requests") == 0, F.lit(None).cast("double"))
    for i, bound in enumerate(bounds):
        below = F.col(f"le_{i - 1}") if i else F.lit(0.0)
        lower = bounds[i - 1] if i else 0.0
        inside = (wanted - below) / F.nullif(F.col(f"le_{i}") - below, F.lit(0.0))
        chain = chain.when(F.col(f"le_{i}") >= wanted, F.lit(lower) + F.lit(bound - lower) * inside)
    below, lower = F.col(f"le_{len(bounds) - 1}"), F.lit(bounds[-1])
    return chain.otherwise(lower + (F.col("most") - lower) * (wanted - below) / (F.col("requests") - below))


def latency_percentiles(
    log: DataFrame,
    *by: str,
    window: str = QUALITY_WINDOW,
    quantiles: tuple[float, ...] = QUANTILES,
) -> DataFrame:
    """Exact percentiles: the smallest duration that at least that share of a group does not exceed.

    Equal durations are counted first, on the map side too. Running counts come from slices of the
    order, so that a group of any size is spread over tasks; no group's durations meet in one. A group's
    number of requests is what is counted up to a duration and from it on.
    """
    groups = ["window_start", *by]
    spans = log.select(F.window("ts", window).start.alias("window_start"), *by, "duration_s")
    known = F.when(F.col("duration_s").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = sliced(spans.groupBy(*groups, "duration_s").agg(F.sum(known).alias("n")), groups, ["duration_s"])
    running = running_sum(counted, groups, ["duration_s"], {"upto": "n"})
    running = running_sum(running, groups, ["duration_s"], {"from_here": "n"}, backwards=True)
    requests = F.col("upto") + F.col("from_here") - F.col("n")
    return running.withColumn("requests", requests).groupBy(*groups).agg(
        F.max("requests").alias("requests"),
        *[
            F.min(F.when(F.col("upto") >= F.col("requests") * F.lit(q), F.col("duration_s"))).alias(f"p{round(q * 100)}")
            for q in quantiles
        ],
    )
