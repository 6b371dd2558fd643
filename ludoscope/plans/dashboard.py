"""Roll-ups behind the dashboard's figures and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def home_kpis(results: dict[str, DataFrame]) -> DataFrame:
    """Rows of each result."""
    stacked = None
    for name, df in results.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kpi"), "n")
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked


def _number(value: Column) -> Column:
    """A number, or text holding one; anything else counts as 0."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def _events(value: Column) -> Column:
    return _total(value).cast("bigint")


# Measure of each topic on the live page.
_LIVE_EVENTS = {
    "purchases": lambda: _number(F.col("num_purchases")),
    "reviews": lambda: _number(F.col("num_reviews")),
    "sessions": lambda: _number(F.col("num_starts")) + _number(F.col("num_ends")),
    "wishlist": lambda: _number(F.col("net_added")),
}
_LIVE_RANKING = {**_LIVE_EVENTS, "purchases": lambda: _number(F.col("revenue_net_usd"))}


def live_kpis(state: DataFrame) -> DataFrame:
    """One row of totals over the live state."""
    per_topic = {
        topic: F.when(F.col("topic") == topic, events()) for topic, events in _LIVE_EVENTS.items()
    }
    revenue = F.when(F.col("topic") == "purchases", _number(F.col("revenue_net_usd")))
    return state.agg(
        F.coalesce(numbers.money_sum(revenue).cast("double"), F.lit(0.0)).alias("total_revenue"),
        *[_events(value).alias(f"total_{topic}") for topic, value in per_topic.items()],
    )


def live_pulse(state: DataFrame) -> DataFrame:
    """Events per topic, as one row each."""
    totals = live_kpis(state)
    rows = F.array(
        *[
            F.struct(F.lit(topic.title()).alias("topic"), F.col(f"total_{topic}").alias("events"))
            for topic in _LIVE_EVENTS
        ]
    )
    return totals.select(F.inline(rows))


def live_top(state: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` games with the highest measure of each topic."""
    stacked = None
    for topic, measure in _LIVE_RANKING.items():
        one = (
            state.filter(F.col("topic") == topic)
            .select("topic", "game_id", measure().alias("measure"))
            .orderBy(F.col("measure").desc(), "game_id")
            .limit(n)
        )
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked


def anomaly_type_counts(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.groupBy("anomaly_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "anomaly_type")
    )


def severity_kpis(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if(F.col("severity") == "Medium").alias("medium"),
    )


def anomaly_hierarchy(findings: DataFrame) -> DataFrame:
    """Metric summed by type, then severity, then entity; an upper level has NULL below it."""
    levels = ["anomaly_type", "severity", "entity_name"]
    return (
        findings.rollup(*levels)
        .agg(
            F.sum(F.col("metric_value").cast("decimal(20,6)")).cast("double").alias("metric_value"),
            F.grouping_id(*levels).alias("_level"),
        )
        .filter(F.col("_level") < 7)
        .drop("_level")
    )


def genre_totals(genres: DataFrame) -> DataFrame:
    return genres.agg(
        F.count(F.lit(1)).alias("genres"),
        F.sum("num_games").alias("total_games"),
        F.sum("total_owners").alias("total_owners"),
    )


def history_kpis(
    purchases: DataFrame, reviews: DataFrame, sessions: DataFrame, wishlist: DataFrame
) -> DataFrame:
    """Totals over the four histories of one range."""
    zero = F.lit(0).cast("bigint")
    revenue = numbers.money_sum(F.col("revenue")).cast("double")
    parts = (
        purchases.agg(
            F.coalesce(revenue, F.lit(0.0)).alias("total_revenue"),
            F.coalesce(F.sum("purchases"), zero).alias("total_purchases"),
        ),
        reviews.agg(F.coalesce(F.sum("reviews"), zero).alias("total_reviews")),
        sessions.agg(F.coalesce(F.sum("starts"), zero).alias("total_sessions")),
        wishlist.agg(F.coalesce(F.sum("net_added"), zero).alias("total_wishlist_net")),
    )
    row = parts[0]
    for part in parts[1:]:
        # Both sides are global aggregates of exactly one row.
        row = row.crossJoin(F.broadcast(part))
    return row


def trending_podium(trending: DataFrame, places: int = 3) -> DataFrame:
    """The first places with the labels of their flags."""
    badges = F.concat_ws(
        " ",
        F.when(F.col("had_viral_purchases_period"), "VIRAL"),
        F.when(F.col("had_review_bomb_period"), "BOMB"),
        F.when(F.col("had_ccu_spike_period"), "CCU"),
    )
    return (
        trending.orderBy(F.col("trending_score").desc(), "steam_app_id")
        .limit(places)
        .select(
            "game_name",
            "trending_score",
            F.coalesce("primary_genre", F.lit("-")).alias("primary_genre"),
            badges.alias("badges"),
        )
    )


def top_trending(trending: DataFrame, n: int = 25) -> DataFrame:
    return (
        trending.orderBy(F.col("trending_score").desc(), "steam_app_id")
        .limit(n)
        .select("steam_app_id", "game_name", "trending_score")
    )


def top_genres(genre_stats: DataFrame, n: int = 15) -> DataFrame:
    return (
        genre_stats.filter(F.col("rank_by_owners") <= n)
        .select("genre", "total_owners", "positive_rate_pct", "rank_by_owners")
        .orderBy("rank_by_owners")
    )
