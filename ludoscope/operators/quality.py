"""Data checks. Each returns the rows that fail, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import POPULARITY_TIERS

# The columns that must be present and unique.
KEYS = {
    "igdb_games": "igdb_id",
    "steamspy_games": "appid",
    "mart_games": "steam_app_id",
    "mart_trending_games": "steam_app_id",
    "mart_genre_stats": "genre",
    "mart_publisher_stats": "publisher",
    "mart_price_analysis": "price_tier",
    "mart_review_analysis": "steam_app_id",
    "mart_session_analysis": "steam_app_id",
}
ACCEPTED = {("mart_games", "popularity_tier"): POPULARITY_TIERS}
NODE_KEYS = {
    "Game": "steam_app_id",
    "Genre": "name",
    "Publisher": "name",
    "Developer": "name",
    "Platform": "name",
    "Theme": "name",
    "Tag": "name",
}


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count; NULL is not a value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > 1)


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is not in the list; NULL passes."""
    return df.filter(~F.col(column).isin(*values))


def failure_counts(checks: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """(check, table, column) -> number of failing rows, stacked into one report."""
    report = None
    for (check, table, column), failing in checks.items():
        one = failing.agg(F.count(F.lit(1)).alias("failures")).select(
            F.lit(check).alias("check_name"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            "failures",
        )
        report = one if report is None else report.unionByName(one)
    return report


def check_not_null(tables: dict[str, DataFrame], keys: dict[str, str] = KEYS) -> DataFrame:
    return failure_counts(
        {("not_null", t, keys[t]): not_null(df, keys[t]) for t, df in tables.items()}
    )


def check_unique(tables: dict[str, DataFrame], keys: dict[str, str] = KEYS) -> DataFrame:
    return failure_counts({("unique", t, keys[t]): unique(df, keys[t]) for t, df in tables.items()})


def check_accepted_values(tables: dict[str, DataFrame], accepted: dict = ACCEPTED) -> DataFrame:
    return failure_counts(
        {
            ("accepted_values", t, c): accepted_values(tables[t], c, values)
            for (t, c), values in accepted.items()
            if t in tables
        }
    )
