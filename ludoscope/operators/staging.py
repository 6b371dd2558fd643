"""Staging projections: renamed columns, derived measures and per-window flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, numbers

# A window is flagged from these counts on.
VIRAL_PURCHASES = 15
CCU_SPIKE_STARTS = 20
VIRAL_WISHLIST = 15
# A review bomb has this many reviews and a low rating, or this many and few recommendations.
BOMB_REVIEWS, BOMB_RATING = 10, 4
BOMB_REVIEWS_RECOMMEND, BOMB_RECOMMEND_PCT = 5, 30
WINDOW_SECONDS = 30


def _loaded_at(df: DataFrame) -> Column:
    """Load time where the table records one."""
    known = "_loaded_at" in df.columns
    return (F.col("_loaded_at") if known else F.lit(None).cast("timestamp")).alias("loaded_at")


def _hours(minutes: str, alias: str) -> Column:
    return F.round(F.col(minutes) / F.lit(60.0), 1).alias(alias)


def stage_catalog_a(table: DataFrame) -> DataFrame:
    return table.filter(F.col("igdb_id").isNotNull()).select(
        F.col("igdb_id").alias("game_id"),
        F.col("name").alias("game_name"),
        "summary",
        "rating",
        F.round(F.col("rating") / F.lit(10.0), 2).alias("rating_normalized"),
        "rating_count",
        "release_date",
        "genres",
        F.trim(F.split_part("genres", F.lit(","), F.lit(1))).alias("primary_genre"),
        "themes",
        "platforms",
        "keywords",
        "game_modes",
        "developer",
        "publisher",
        _loaded_at(table),
    )


def stage_catalog_b(table: DataFrame) -> DataFrame:
    num_reviews = F.col("positive") + F.col("negative")
    return table.filter(F.col("appid").isNotNull()).select(
        F.col("appid").alias("steam_app_id"),
        F.col("name").alias("game_name"),
        "developer",
        "publisher",
        "owners_range",
        "owners_estimate",
        F.col("ccu").alias("concurrent_users"),
        "price_usd",
        F.col("initialprice_usd").alias("initial_price_usd"),
        "discount_pct",
        F.col("positive").alias("positive_reviews"),
        F.col("negative").alias("negative_reviews"),
        "review_score",
        _hours("average_forever", "avg_playtime_hours"),
        _hours("average_2weeks", "avg_playtime_2weeks_hours"),
        _hours("median_forever", "median_playtime_hours"),
        labels.price_tier(F.col("price_usd")).alias("price_tier"),
        labels.review_label(F.col("review_score"), num_reviews).alias("review_label"),
        "tags",
        "languages",
        F.col("genre").alias("steam_genre"),
        _loaded_at(table),
    )


def _stage_events(events: DataFrame, *derived: Column, needs_game: bool, rename: dict | None = None):
    rename = {"game_id": "steam_app_id", **(rename or {})}
    kept = events.filter(F.col("event_id").isNotNull())
    if needs_game:
        kept = kept.filter(F.col("game_id").isNotNull())
    return kept.select(
        *[F.col(c).alias(rename.get(c, c)) for c in events.columns if c != "_loaded_at"],
        *derived,
        F.date_trunc("hour", "event_time").alias("event_hour"),
        F.date_trunc("day", "event_time").alias("event_day"),
        _loaded_at(events),
    )


def stage_purchases(events: DataFrame) -> DataFrame:
    # Decimals keep the half cents of 25/50/75 % discounts exact, so they round up as they should.
    net = numbers.net_price(F.col("price_usd"), F.col("discount_pct"), 2)
    return _stage_events(events, net.alias("revenue_net_usd"), needs_game=True)


def stage_reviews(events: DataFrame) -> DataFrame:
    return _stage_events(events, needs_game=True)


def stage_sessions(events: DataFrame) -> DataFrame:
    hours = numbers.ratio_half_up(F.col("duration_seconds"), 3600, 2)
    return _stage_events(events, hours.alias("duration_hours"), needs_game=False)


def stage_wishlist(events: DataFrame) -> DataFrame:
    return _stage_events(events, needs_game=False, rename={"source": "wishlist_source"})


def _stage_windows(windows: DataFrame, seconds: int, *derived: Column) -> DataFrame:
    measures = [c for c in windows.columns if c not in ("window_start", "game_id", "_loaded_at")]
    return windows.filter(F.col("game_id").isNotNull()).select(
        "window_start",
        (F.col("window_start") + F.make_dt_interval(secs=F.lit(seconds))).alias("window_end"),
        F.col("game_id").alias("steam_app_id"),
        *measures,
        *derived,
        _loaded_at(windows),
    )


def _flag(condition: Column) -> Column:
    """True or false, never NULL."""
    return F.coalesce(condition, F.lit(False))


def stage_purchase_windows(
    windows: DataFrame, *, viral_from: int = VIRAL_PURCHASES, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    per_purchase = numbers.money(F.col("revenue_net_usd")) / F.nullif(
        F.col("num_purchases"), F.lit(0).cast("bigint")
    )
    return _stage_windows(
        windows,
        window_seconds,
        F.round(per_purchase, 2).cast("double").alias("avg_price_per_purchase"),
        _flag(F.col("num_purchases") >= viral_from).alias("is_viral"),
    )


def stage_review_windows(
    windows: DataFrame,
    *,
    bomb_from: int = BOMB_REVIEWS,
    bomb_rating: float = BOMB_RATING,
    bomb_from_recommend: int = BOMB_REVIEWS_RECOMMEND,
    bomb_recommend_pct: float = BOMB_RECOMMEND_PCT,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    low_rating = (F.col("num_reviews") >= bomb_from) & (F.col("avg_rating") < bomb_rating)
    unloved = (F.col("num_reviews") >= bomb_from_recommend) & (
        F.col("recommend_pct") < bomb_recommend_pct
    )
    return _stage_windows(
        windows, window_seconds, (_flag(low_rating) | _flag(unloved)).alias("is_review_bomb")
    )


def stage_session_windows(
    windows: DataFrame, *, spike_from: int = CCU_SPIKE_STARTS, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    return _stage_windows(
        windows,
        window_seconds,
        F.round(F.col("avg_duration_sec") / F.lit(60.0), 1).alias("avg_duration_min"),
        _flag(F.col("num_starts") >= spike_from).alias("is_ccu_spike"),
    )


def stage_wishlist_windows(
    windows: DataFrame, *, viral_from: int = VIRAL_WISHLIST, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    return _stage_windows(
        windows, window_seconds, _flag(F.col("net_added") >= viral_from).alias("is_viral_wishlist")
    )
