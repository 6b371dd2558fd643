"""Flattening of raw catalogue records into the stored catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times


def flatten_catalog_a(records: DataFrame) -> DataFrame:
    lists = ("genres", "themes", "platforms", "keywords", "game_modes")
    return records.select(
        F.col("id").alias("igdb_id"),
        "name",
        "summary",
        "rating",
        "rating_count",
        times.epoch_date(F.col("first_release_date")).alias("release_date"),
        *[text.joined_names(F.col(c)).alias(c) for c in lists],
        text.joined_companies(F.col("involved_companies"), "developer").alias("developer"),
        text.joined_companies(F.col("involved_companies"), "publisher").alias("publisher"),
    )


def _counter(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0))


def review_score(positive: Column, negative: Column) -> Column:
    """Share of positive reviews in percent, one decimal; NULL without reviews."""
    total = positive + negative
    return F.when(total > 0, F.round(positive * F.lit(100.0) / total, 1))


def flatten_catalog_b(records: DataFrame) -> DataFrame:
    counters = ("average_forever", "average_2weeks", "median_forever", "median_2weeks", "ccu")
    return records.select(
        F.col("appid").cast("int").alias("appid"),
        "name",
        "developer",
        "publisher",
        F.coalesce("score_rank", F.lit("")).alias("score_rank"),
        F.col("owners").alias("owners_range"),
        text.owners_midpoint(F.col("owners")).alias("owners_estimate"),
        *[_counter(c).alias(c) for c in counters],
        text.cents_to_dollars(F.col("price")).alias("price_usd"),
        text.cents_to_dollars(F.col("initialprice")).alias("initialprice_usd"),
        _counter("discount").alias("discount_pct"),
        _counter("positive").alias("positive"),
        _counter("negative").alias("negative"),
        review_score(_counter("positive"), _counter("negative")).alias("review_score"),
        text.tags_to_string(F.col("tags")).alias("tags"),
        "languages",
        "genre",
    )


def enrich_details(
    games: DataFrame, details: DataFrame, *, order_by: str = "appid", first: int | None = None
) -> DataFrame:
    """Overwrite tags, languages and genre of the ``first`` games where the detail has a value.

    ``details`` holds one row per app id.
    """
    fields = ("tags", "languages", "genre")
    found = details.select("appid", *[F.col(f).alias(f"detail_{f}") for f in fields])
    if first is not None:
        chosen = games.select("appid", order_by).distinct().orderBy(order_by, "appid").limit(first)
        found = found.join(chosen.select("appid").distinct(), "appid", "left_semi")
    joined = games.join(found, "appid", "left")
    return joined.select(
        *[
            text.first_filled(F.col(f"detail_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in games.columns
        ]
    )
