"""The seven marts.

Each takes staged DataFrames and returns one. ``games`` is the result of :func:`mart_games`, which
six marts share: store it once (see ``materialise``) when more than one of them is built.

Games meet their activity in sort-merge joins by hint: in compressed files the games look small enough to go
through the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, numbers, text, times
from ..operators.ranking import row_numbers
from .materialise import stored

LOOKBACK_DAYS = 30
PRICE_LOOKBACK_HOURS = 24
# Weight of each activity in the trending score.
WEIGHTS = {"purchases": 5, "reviews": 3, "sessions": 1, "wishlist": 2}


# -- games -----------------------------------------------------------------------------------------


def mart_games(catalog_b: DataFrame, catalog_a: DataFrame, *, dedupe: bool = True) -> DataFrame:
    """Catalogue B enriched with the catalogue A records of the same title, scored and tiered.

    Of the records of one title in A the one with the most ratings counts; without ``dedupe`` all do,
    and a title that occurs several times there multiplies the game's row. A blank title matches none.
    """
    a = catalog_a.select(
        text.name_key(F.col("game_name")).alias("_key"),
        F.col("game_id").alias("igdb_id"),
        F.col("summary").alias("igdb_summary"),
        F.col("rating").alias("igdb_rating"),
        F.col("rating_normalized").alias("igdb_rating_norm"),
        F.col("rating_count").alias("igdb_rating_count"),
        "release_date",
        F.col("genres").alias("igdb_genres"),
        "primary_genre",
        "themes",
        "platforms",
        "keywords",
        "game_modes",
        F.col("developer").alias("igdb_developer"),
        F.col("publisher").alias("igdb_publisher"),
    ).filter(text.filled(F.col("_key")))
    if dedupe:
        best = Window.partitionBy("_key").orderBy(
            F.col("igdb_rating_count").desc_nulls_last(), F.col("igdb_id")
        )
        a = a.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).drop("_rn")

    b = catalog_b.select(
        "steam_app_id",
        "game_name",
        F.col("developer").alias("steam_developer"),
        F.col("publisher").alias("steam_publisher"),
        "owners_estimate",
        "owners_range",
        "concurrent_users",
        "price_usd",
        "initial_price_usd",
        "discount_pct",
        "price_tier",
        "positive_reviews",
        "negative_reviews",
        "review_score",
        "review_label",
        "avg_playtime_hours",
        "avg_playtime_2weeks_hours",
        "median_playtime_hours",
        "tags",
        "languages",
        "steam_genre",
        text.name_key(F.col("game_name")).alias("_key"),
    )
    # A title of which A has one record cannot be hot there, so one outer join does and B is read once.
    joined = b.join(a.hint("merge"), "_key", "left") if dedupe else _left_join_any_skew(b, a, "_key")
    joined = joined.drop("_key")
    scored = joined.select(
        "*",
        text.first_filled(F.col("igdb_developer"), F.col("steam_developer")).alias("developer"),
        text.first_filled(F.col("igdb_publisher"), F.col("steam_publisher")).alias("publisher"),
        text.first_filled(F.col("primary_genre"), F.col("steam_genre")).alias("primary_genre_final"),
        popularity_score(
            F.col("owners_estimate"), F.col("review_score"), F.col("concurrent_users")
        ).alias("popularity_score"),
    )
    return scored.withColumn("popularity_tier", labels.popularity_tier(F.col("popularity_score")))


def _left_join_any_skew(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join that survives a key holding a large part of either side.

    Adaptive execution splits a hot key on both sides of an inner join, but on the left side only
    of an outer join. So matched and unmatched rows are planned apart: the unmatched ones need the
    distinct right keys only, which pre-aggregate before the shuffle. Both are sort-merge joins by hint:
    by the size of the compressed files either side may look small enough to go through the driver.
    """
    matched = left.join(right.hint("merge"), key, "inner")
    unmatched = left.join(right.select(key).distinct().hint("merge"), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def popularity_score(owners: Column, review_score: Column, concurrent: Column) -> Column:
    """Weighted logs of audience and current players plus the review score, two decimals."""
    return F.round(
        numbers.log_or_zero(owners) * 5
        + F.coalesce(review_score, F.lit(0.0)) * 0.3
        + numbers.log_or_zero(concurrent) * 2,
        2,
    )


# -- market statistics -----------------------------------------------------------------------------


def _audience(*extra: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("num_games"),
        *extra,
        F.sum("owners_estimate").alias("total_owners"),
        numbers.decimal_avg(F.col("owners_estimate"), 0, 0).alias("avg_owners"),
        F.sum(F.col("positive_reviews").cast("bigint")).alias("total_positive_reviews"),
        F.sum(F.col("negative_reviews").cast("bigint")).alias("total_negative_reviews"),
        numbers.decimal_avg(F.col("review_score"), 1, 2).alias("avg_review_score"),
        numbers.decimal_avg(F.col("price_usd"), 2, 2).alias("avg_price_usd"),
        numbers.decimal_avg(F.col("popularity_score"), 2, 2).alias("avg_popularity_score"),
    ]


def _positive_rate() -> Column:
    positive = F.col("total_positive_reviews")
    return numbers.share_pct(positive, positive + F.col("total_negative_reviews"))


def _ranked(stats: DataFrame, key: str) -> DataFrame:
    return row_numbers(stats, key, {"rank_by_owners": "total_owners", "rank_by_games": "num_games"})


def mart_genre_stats(games: DataFrame) -> DataFrame:
    """One row per genre with market share, averages and two rankings.

    The grouped table is stored first, since totals and rankings read it again.
    """
    per_genre = (
        games.filter(text.filled(F.col("primary_genre_final")))
        .groupBy(F.col("primary_genre_final").alias("genre"))
        .agg(*_audience())
    )
    per_genre = stored(per_genre, "genre-stats")
    totals = per_genre.agg(F.sum("num_games").alias("_games"))
    ranked = _ranked(per_genre, "genre").join(F.broadcast(totals))
    return ranked.select(
        "genre",
        "num_games",
        numbers.share_pct(F.col("num_games"), F.col("_games")).alias("market_share_pct"),
        "total_owners",
        "avg_owners",
        "total_positive_reviews",
        "total_negative_reviews",
        _positive_rate().alias("positive_rate_pct"),
        "avg_review_score",
        "avg_price_usd",
        "avg_popularity_score",
        "rank_by_owners",
        "rank_by_games",
    )


def mart_publisher_stats(games: DataFrame) -> DataFrame:
    """One row per publisher with market shares, genre breadth and two rankings."""
    per_publisher = (
        games.filter(text.filled(F.col("publisher")))
        .groupBy("publisher")
        .agg(*_audience(F.count_distinct("primary_genre_final").alias("num_distinct_genres")))
    )
    per_publisher = stored(per_publisher, "publisher-stats")
    totals = per_publisher.agg(
        F.sum("num_games").alias("_games"), F.sum("total_owners").alias("_owners")
    )
    ranked = _ranked(per_publisher, "publisher").join(F.broadcast(totals))
    return ranked.select(
        "publisher",
        "num_games",
        "num_distinct_genres",
        numbers.share_pct(F.col("num_games"), F.col("_games")).alias("market_share_games_pct"),
        "total_owners",
        numbers.share_pct(F.col("total_owners"), F.col("_owners")).alias("market_share_owners_pct"),
        "avg_owners",
        _positive_rate().alias("positive_rate_pct"),
        "avg_review_score",
        "avg_price_usd",
        "avg_popularity_score",
        "rank_by_owners",
        "rank_by_games",
    )


def mart_price_analysis(
    games: DataFrame,
    purchase_windows: DataFrame,
    *,
    as_of: datetime | str | None = None,
    hours: int = PRICE_LOOKBACK_HOURS,
) -> DataFrame:
    """Audience and recent sales per price tier."""
    recent = (
        purchase_windows.filter(F.col("window_start") >= times.since(as_of, hours=hours))
        .groupBy("steam_app_id")
        .agg(
            F.sum("num_purchases").alias("_purchases"),
            numbers.money_sum(F.col("revenue_net_usd")).alias("_revenue"),
        )
    )
    per_tier = (
        games.join(recent.hint("merge"), "steam_app_id", "left")
        .groupBy("price_tier")
        .agg(
            F.count(F.lit(1)).alias("num_games"),
            numbers.decimal_avg(F.col("price_usd"), 2, 2).alias("avg_price_usd"),
            F.sum("owners_estimate").alias("total_owners"),
            numbers.decimal_avg(F.col("owners_estimate"), 0, 0).alias("avg_owners"),
            numbers.decimal_avg(F.col("review_score"), 1, 2).alias("avg_review_score"),
            numbers.decimal_avg(F.col("popularity_score"), 2, 2).alias("avg_popularity_score"),
            F.coalesce(F.sum("_purchases"), F.lit(0).cast("bigint")).alias("total_purchases_24h"),
            F.round(F.coalesce(F.try_sum("_revenue"), F.lit(0)), 2).cast("decimal(30,2)").alias("_revenue"),
        )
    )
    # One row per tier, so this window sees six rows at most.
    tiers = Window.partitionBy()
    revenue_all = F.sum("_revenue").over(tiers).cast("decimal(30,2)")
    revenue_share = F.col("_revenue") * 100 / F.nullif(F.col("_revenue_all"), F.lit(0).cast("decimal(30,2)"))
    return (
        per_tier.withColumns(
            {"_owners_all": F.sum("total_owners").over(tiers), "_revenue_all": revenue_all}
        )
        .select(
            "price_tier",
            "num_games",
            "avg_price_usd",
            "total_owners",
            "avg_owners",
            numbers.share_pct(F.col("total_owners"), F.col("_owners_all")).alias("owners_share_pct"),
            "avg_review_score",
            "avg_popularity_score",
            "total_purchases_24h",
            F.col("_revenue").cast("double").alias("total_revenue_24h_usd"),
            F.round(revenue_share, 2).cast("double").alias("revenue_share_pct_24h"),
        )
        .orderBy(F.col("avg_popularity_score").desc_nulls_last(), "price_tier")
    )


# -- activity of the lookback period ---------------------------------------------------------------


def _recent(windows: DataFrame, as_of, lookback_days: int) -> DataFrame:
    return windows.filter(F.col("window_start") >= times.since(as_of, days=lookback_days))


def _average(name: str, weight: str, weighted: bool) -> Column:
    """Average over windows, or over the events behind them."""
    if not weighted:
        return numbers.exact_avg(F.col(name))
    counted = F.when(F.col(name).isNotNull(), F.col(weight))
    return F.sum(F.col(name) * counted) / F.nullif(F.sum(counted), F.lit(0).cast("bigint"))


def mart_review_analysis(
    games: DataFrame,
    review_windows: DataFrame,
    *,
    as_of: datetime | str | None = None,
    lookback_days: int = LOOKBACK_DAYS,
    weighted: bool = False,
) -> DataFrame:
    """Recent reviews against the catalogue's review score, for games reviewed in the period."""
    recent = (
        _recent(review_windows, as_of, lookback_days)
        .groupBy("steam_app_id")
        .agg(
            F.coalesce(F.sum("num_reviews"), F.lit(0).cast("bigint")).alias("stream_reviews_period"),
            _average("avg_rating", "num_reviews", weighted).alias("stream_avg_rating_period"),
            _average("recommend_pct", "num_reviews", weighted).alias("stream_recommend_pct_period"),
            F.count_if("is_review_bomb").alias("review_bomb_windows_period"),
            F.coalesce(F.bool_or("is_review_bomb"), F.lit(False)).alias("had_review_bomb_period"),
        )
        .filter((F.col("stream_reviews_period") > 0) | F.col("had_review_bomb_period"))
    )
    drift = F.col("stream_recommend_pct_period").cast("decimal(18,8)") - F.col("review_score").cast(
        "decimal(18,8)"
    )
    # Games without recent reviews are not reported, so an inner join says the same as an outer one.
    return (
        games.join(recent.hint("merge"), "steam_app_id")
        .select(
            "steam_app_id",
            "game_name",
            "developer",
            "publisher",
            F.col("primary_genre_final").alias("primary_genre"),
            F.lit(lookback_days).alias("lookback_days"),
            F.col("positive_reviews").alias("historical_positive"),
            F.col("negative_reviews").alias("historical_negative"),
            F.col("review_score").alias("historical_review_score"),
            F.col("review_label").alias("historical_label"),
            "stream_reviews_period",
            "stream_avg_rating_period",
            "stream_recommend_pct_period",
            "review_bomb_windows_period",
            "had_review_bomb_period",
            F.round(drift, 2).cast("double").alias("sentiment_drift_pct"),
        )
        .orderBy(
            F.col("review_bomb_windows_period").desc(),
            F.col("stream_reviews_period").desc(),
            "steam_app_id",
        )
    )


def mart_session_analysis(
    games: DataFrame,
    session_windows: DataFrame,
    *,
    as_of: datetime | str | None = None,
    lookback_days: int = LOOKBACK_DAYS,
    weighted: bool = False,
) -> DataFrame:
    """Recent play sessions: volume, spikes, peak and completion, for games played in the period."""
    zero = F.lit(0).cast("bigint")
    recent = (
        _recent(session_windows, as_of, lookback_days)
        .groupBy("steam_app_id")
        .agg(
            F.coalesce(F.sum("num_starts"), zero).alias("total_starts_period"),
            F.coalesce(F.sum("num_ends"), zero).alias("total_ends_period"),
            _average("avg_duration_sec", "num_ends", weighted).alias("_duration"),
            F.count_if("is_ccu_spike").alias("ccu_spike_windows_period"),
            F.coalesce(F.bool_or("is_ccu_spike"), F.lit(False)).alias("had_ccu_spike_period"),
            F.coalesce(F.max("num_starts"), zero).alias("peak_starts_in_window_period"),
        )
        .filter((F.col("total_starts_period") > 0) | F.col("had_ccu_spike_period"))
    )
    return (
        games.join(recent.hint("merge"), "steam_app_id")
        .select(
            "steam_app_id",
            "game_name",
            "developer",
            F.col("primary_genre_final").alias("primary_genre"),
            "owners_estimate",
            F.col("concurrent_users").alias("steam_concurrent_users"),
            F.col("avg_playtime_hours").alias("historical_avg_playtime_hours"),
            F.lit(lookback_days).alias("lookback_days"),
            "total_starts_period",
            "total_ends_period",
            F.round((F.col("_duration") / 60.0).cast("decimal(20,8)"), 1)
            .cast("double")
            .alias("avg_session_duration_min_period"),
            "ccu_spike_windows_period",
            "had_ccu_spike_period",
            "peak_starts_in_window_period",
            numbers.share_pct(F.col("total_ends_period"), F.col("total_starts_period")).alias(
                "completion_rate_pct"
            ),
        )
        .orderBy(
            F.col("peak_starts_in_window_period").desc(),
            F.col("total_starts_period").desc(),
            "steam_app_id",
        )
    )


def recent_activity(
    purchase_windows: DataFrame,
    review_windows: DataFrame,
    session_windows: DataFrame,
    wishlist_windows: DataFrame,
    *,
    as_of: datetime | str | None = None,
    lookback_days: int = LOOKBACK_DAYS,
    weighted: bool = False,
) -> DataFrame:
    """All activity of a game in one row.

    The four window tables are stacked and grouped once: one shuffle, already reduced on the map
    side, instead of four groupings and the joins between them. A measure of another topic is NULL
    on a stacked row, and every aggregate below ignores NULL.
    """
    purchases = _recent(purchase_windows, as_of, lookback_days).select(
        "steam_app_id",
        "num_purchases",
        numbers.money(F.col("revenue_net_usd")).alias("revenue"),
        "is_viral",
    )
    reviews = _recent(review_windows, as_of, lookback_days).select(
        "steam_app_id", "num_reviews", "avg_rating", "recommend_pct", "is_review_bomb"
    )
    sessions = _recent(session_windows, as_of, lookback_days).select(
        "steam_app_id", "num_starts", "num_ends", "avg_duration_sec", "is_ccu_spike"
    )
    wishlist = _recent(wishlist_windows, as_of, lookback_days).select(
        "steam_app_id", "net_added", "is_viral_wishlist"
    )
    stacked = purchases
    for rows in (reviews, sessions, wishlist):
        stacked = stacked.unionByName(rows, allowMissingColumns=True)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    def ever(name: str) -> Column:
        return F.coalesce(F.bool_or(name), F.lit(False))

    return stacked.groupBy("steam_app_id").agg(
        total("num_purchases").alias("total_purchases_period"),
        F.coalesce(F.try_sum("revenue").cast("double"), F.lit(0.0)).alias("total_revenue_period_usd"),
        total("num_reviews").alias("total_reviews_period"),
        _average("avg_rating", "num_reviews", weighted).alias("avg_rating_period"),
        _average("recommend_pct", "num_reviews", weighted).alias("recommend_pct_period"),
        total("num_starts").alias("total_sessions_period"),
        _average("avg_duration_sec", "num_ends", weighted).alias("avg_session_duration_sec_period"),
        total("net_added").alias("wishlist_net_added_period"),
        ever("is_viral").alias("had_viral_purchases_period"),
        ever("is_review_bomb").alias("had_review_bomb_period"),
        ever("is_ccu_spike").alias("had_ccu_spike_period"),
        ever("is_viral_wishlist").alias("had_viral_wishlist_period"),
    )


def mart_trending(
    games: DataFrame, activity: DataFrame, *, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Games with any recent activity, by trending score.

    ``activity`` comes from :func:`recent_activity`. A game whose wishlist only shrank stays, with
    a negative score.
    """
    score = (
        F.col("total_purchases_period") * WEIGHTS["purchases"]
        + F.col("total_reviews_period") * WEIGHTS["reviews"]
        + F.col("total_sessions_period") * WEIGHTS["sessions"]
        + F.col("wishlist_net_added_period") * WEIGHTS["wishlist"]
    )
    volume = (
        F.col("total_purchases_period")
        + F.col("total_reviews_period")
        + F.col("total_sessions_period")
        + F.abs("wishlist_net_added_period")
    )
    # Idle games are dropped anyway, so the join is an inner one.
    return (
        games.select(
            "steam_app_id",
            "game_name",
            "developer",
            "publisher",
            F.col("primary_genre_final").alias("primary_genre"),
            "owners_estimate",
            "popularity_score",
            "popularity_tier",
            F.lit(lookback_days).alias("lookback_days"),
        )
        .join(activity.filter(volume > 0).hint("merge"), "steam_app_id")
        .withColumn("trending_score", score)
        .orderBy(F.col("trending_score").desc(), "steam_app_id")
    )
