"""Parametrised read queries over marts, window tables, findings and live state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, times


def list_games(
    games: DataFrame,
    *,
    min_owners: int = 0,
    genre: str | None = None,
    tier: str | None = None,
    limit: int = 100,
) -> DataFrame:
    found = games.filter(F.col("owners_estimate") >= min_owners)
    if genre:
        found = found.filter(F.col("primary_genre_final").ilike(f"%{genre}%"))
    if tier:
        found = found.filter(F.col("popularity_tier") == tier)
    return (
        found.orderBy(
            F.col("popularity_score").desc_nulls_last(), "steam_app_id", F.col("igdb_id").asc_nulls_last()
        )
        .limit(limit)
        .select(
            "steam_app_id",
            "game_name",
            "developer",
            "publisher",
            F.col("primary_genre_final").alias("primary_genre"),
            "price_usd",
            "price_tier",
            "review_score",
            "review_label",
            "owners_estimate",
            "popularity_score",
            "popularity_tier",
        )
    )


def get_game(games: DataFrame, app_id: int) -> DataFrame:
    return games.filter(F.col("steam_app_id") == app_id)


def list_genres(genre_stats: DataFrame, limit: int = 50) -> DataFrame:
    return (
        genre_stats.filter(F.col("rank_by_owners") <= limit)
        .select(
            "genre",
            "num_games",
            "market_share_pct",
            "total_owners",
            "avg_owners",
            "positive_rate_pct",
            "avg_review_score",
            "avg_price_usd",
            "avg_popularity_score",
            "rank_by_owners",
            "rank_by_games",
        )
        .orderBy("rank_by_owners")
    )


def list_publishers(publisher_stats: DataFrame, limit: int = 50) -> DataFrame:
    return (
        publisher_stats.filter(F.col("rank_by_owners") <= limit)
        .select(
            "publisher",
            "num_games",
            "num_distinct_genres",
            "market_share_games_pct",
            "market_share_owners_pct",
            "total_owners",
            "positive_rate_pct",
            "avg_review_score",
            "avg_price_usd",
            "avg_popularity_score",
            "rank_by_owners",
        )
        .orderBy("rank_by_owners")
    )


def list_trending(trending: DataFrame, *, only_anomalies: bool = False, limit: int = 20) -> DataFrame:
    if only_anomalies:
        trending = trending.filter(
            F.col("had_viral_purchases_period")
            | F.col("had_review_bomb_period")
            | F.col("had_ccu_spike_period")
            | F.col("had_viral_wishlist_period")
        )
    return (
        trending.select(
            "steam_app_id",
            "game_name",
            "developer",
            "publisher",
            "primary_genre",
            "trending_score",
            "total_purchases_period",
            "total_revenue_period_usd",
            "total_reviews_period",
            "avg_rating_period",
            "total_sessions_period",
            "wishlist_net_added_period",
            "had_viral_purchases_period",
            "had_review_bomb_period",
            "had_ccu_spike_period",
            "had_viral_wishlist_period",
        )
        .orderBy(F.col("trending_score").desc(), "steam_app_id")
        .limit(limit)
    )


def flagged_windows(
    purchase_windows: DataFrame,
    review_windows: DataFrame,
    session_windows: DataFrame,
    wishlist_windows: DataFrame,
) -> DataFrame:
    """Every flagged window of the four topics in one shape."""

    def flagged(df: DataFrame, flag: str, kind: str, metric: str, metric_2: str | None) -> DataFrame:
        second = F.col(metric_2) if metric_2 else F.lit(None)
        return df.filter(F.col(flag)).select(
            F.lit(kind).alias("anomaly_type"),
            "steam_app_id",
            "window_start",
            F.col(metric).cast("bigint").alias("metric"),
            second.cast("double").alias("metric_2"),
        )

    return (
        flagged(purchase_windows, "is_viral", "is_viral_purchases", "num_purchases", None)
        .unionByName(flagged(review_windows, "is_review_bomb", "is_review_bomb", "num_reviews", "avg_rating"))
        .unionByName(flagged(session_windows, "is_ccu_spike", "is_ccu_spike", "num_starts", "avg_duration_sec"))
        .unionByName(flagged(wishlist_windows, "is_viral_wishlist", "is_viral_wishlist", "net_added", None))
    )


def stream_anomalies(flagged: DataFrame, limit: int = 50) -> DataFrame:
    """Newest flagged windows first."""
    return flagged.orderBy(F.col("window_start").desc(), "anomaly_type", "steam_app_id").limit(limit)


def graph_anomalies(
    findings: DataFrame, *, anomaly_type: str | None = None, severity: str | None = None, limit: int = 100
) -> DataFrame:
    if anomaly_type:
        findings = findings.filter(F.col("anomaly_type") == anomaly_type)
    if severity:
        findings = findings.filter(F.col("severity") == severity)
    return findings.orderBy(
        F.col("metric_value").desc_nulls_last(), "anomaly_type", "entity_name", "description"
    ).limit(limit)


def review_report(review_analysis: DataFrame, limit: int = 50) -> DataFrame:
    return (
        review_analysis.drop("lookback_days")
        .orderBy(
            F.col("review_bomb_windows_period").desc(),
            F.col("stream_reviews_period").desc(),
            "steam_app_id",
        )
        .limit(limit)
    )


def session_report(session_analysis: DataFrame, limit: int = 50) -> DataFrame:
    return (
        session_analysis.drop("lookback_days")
        .orderBy(
            F.col("peak_starts_in_window_period").desc(),
            F.col("total_starts_period").desc(),
            "steam_app_id",
        )
        .limit(limit)
    )


def price_report(price_analysis: DataFrame) -> DataFrame:
    return price_analysis.orderBy(F.col("avg_popularity_score").desc_nulls_last(), "price_tier")


# -- history ---------------------------------------------------------------------------------------


def _history(windows: DataFrame, granularity: str, days: int, as_of, *measures: Column) -> DataFrame:
    recent = windows.filter(F.col("window_start") >= times.since(as_of, days=days))
    return (
        recent.groupBy(times.bucket(granularity, F.col("window_start")).alias("bucket"))
        .agg(*measures)
        .orderBy("bucket")
    )


def purchase_history(
    windows: DataFrame, granularity: str = "hour", days: int = 1, as_of: datetime | str | None = None
) -> DataFrame:
    return _history(
        windows,
        granularity,
        days,
        as_of,
        F.sum("num_purchases").alias("purchases"),
        numbers.money_sum(F.col("revenue_net_usd")).cast("double").alias("revenue"),
    )


def review_history(
    windows: DataFrame, granularity: str = "hour", days: int = 1, as_of: datetime | str | None = None
) -> DataFrame:
    """Averages are taken over windows, whatever the number of reviews in them."""
    return _history(
        windows,
        granularity,
        days,
        as_of,
        F.sum("num_reviews").alias("reviews"),
        numbers.exact_avg(F.col("avg_rating")).alias("avg_rating"),
        numbers.exact_avg(F.col("recommend_pct")).alias("avg_recommend_pct"),
    )


def session_history(
    windows: DataFrame, granularity: str = "hour", days: int = 1, as_of: datetime | str | None = None
) -> DataFrame:
    return _history(
        windows,
        granularity,
        days,
        as_of,
        F.sum("num_starts").alias("starts"),
        F.sum("num_ends").alias("ends"),
        numbers.exact_avg(F.col("avg_duration_sec")).alias("avg_duration_sec"),
    )


def wishlist_history(
    windows: DataFrame, granularity: str = "hour", days: int = 1, as_of: datetime | str | None = None
) -> DataFrame:
    return _history(
        windows,
        granularity,
        days,
        as_of,
        F.sum("num_added").alias("added"),
        F.sum("num_removed").alias("removed"),
        F.sum("net_added").alias("net_added"),
    )
