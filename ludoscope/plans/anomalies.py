"""Relational anomalies of the graph, one row per finding.

Joins of games, or of edges between them, are sort-merge joins by hint: Spark's guess at a side's size starts
from compressed files and leaves out what ``explode`` adds, and a side it takes for small goes through the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import with_load_time

# Limits of the three detectors, and the wording of their descriptions.
DOMINANCE_PCT, DOMINANCE_GAMES, DOMINANCE_HIGH_PCT = 50, 3, 70
ISOLATED_OWNERS, ISOLATED_SCORE, ISOLATED_HIGH_SCORE = 100_000, 30, 60
INCONSISTENT_RATIO, INCONSISTENT_HIGH_RATIO = 3, 5
DOMINANCE_TEXT = "%s controls %.1f%% of %s (%d/%d games)"
ISOLATED_TEXT = "%s has no similar games (score:%s, tier:%s, owners:%s)"
INCONSISTENT_TEXT = "%s (score:%s) vs %s (score:%s) - %.1fx diff despite similarity=%s (%s)"


def _finding(kind: str, entity: Column, entity_type: str, related: Column, text: Column,
             metric: Column, high_above: float) -> list[Column]:
    return [
        F.lit(kind).alias("anomaly_type"),
        entity.alias("entity_name"),
        F.lit(entity_type).alias("entity_type"),
        related.cast("string").alias("related_entity"),
        text.alias("description"),
        metric.alias("metric_value"),
        F.when(metric > high_above, "High").otherwise("Medium").alias("severity"),
    ]


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def publisher_dominance(
    publisher_edges: DataFrame,
    genre_edges: DataFrame,
    *,
    above_pct: float = DOMINANCE_PCT,
    min_games: int = DOMINANCE_GAMES,
    high_above_pct: float = DOMINANCE_HIGH_PCT,
) -> DataFrame:
    """Publishers that hold more than ``above_pct`` percent of a genre's games."""
    in_genre = genre_edges.select("src_id", F.col("dst").alias("genre"))
    by = publisher_edges.select("src_id", F.col("dst").alias("publisher"))
    held = by.join(in_genre.hint("merge"), "src_id").groupBy("genre", "publisher").agg(F.count(F.lit(1)).alias("held"))
    total = in_genre.groupBy("genre").agg(F.count(F.lit(1)).alias("total"))
    share = F.col("held") * F.lit(100.0) / F.col("total")
    found = (
        held.filter(F.col("held") >= min_games)
        .join(total.hint("merge"), "genre")
        .filter(share > above_pct)
        .withColumn("pct", F.round(share, 1))
    )
    text = F.format_string(
        DOMINANCE_TEXT, "publisher", "pct", "genre", "held", "total"
    )
    return found.select(
        *_finding("publisher_dominance", F.col("publisher"), "Publisher", F.col("genre"), text,
                  F.col("pct"), high_above_pct)
    )


def isolated_games(
    nodes: DataFrame,
    similar: DataFrame,
    *,
    min_owners: int = ISOLATED_OWNERS,
    min_score: float = ISOLATED_SCORE,
    high_above: float = ISOLATED_HIGH_SCORE,
) -> DataFrame:
    """Popular games without a similarity edge in either direction."""
    linked = similar.select(F.explode(F.array("a", "b")).alias("steam_app_id"))
    found = (
        nodes.filter((F.col("owners_estimate") > min_owners) & (F.col("popularity_score") > min_score))
        .join(linked.hint("merge"), "steam_app_id", "left_anti")
    )
    text = F.format_string(
        ISOLATED_TEXT,
        "name",
        _shown(F.col("popularity_score")),
        _shown(F.col("popularity_tier")),
        F.format_number("owners_estimate", 0),
    )
    return found.select(
        *_finding("isolated_game", F.col("name"), "Game", F.lit(None), text,
                  F.col("popularity_score"), high_above)
    )


def sales_inconsistency(
    similar: DataFrame,
    nodes: DataFrame,
    *,
    above_ratio: float = INCONSISTENT_RATIO,
    high_above: float = INCONSISTENT_HIGH_RATIO,
) -> DataFrame:
    """Similar games whose popularity differs by more than the given factor.

    Fresh edges join games of close scores, so this fires on edges kept from an earlier load.
    """
    scores = nodes.filter(F.col("popularity_score") > 0).select(
        "steam_app_id", "name", F.col("popularity_score").alias("score")
    )
    a = scores.select(*[F.col(c).alias(f"a_{c}") for c in scores.columns])
    b = scores.select(*[F.col(c).alias(f"b_{c}") for c in scores.columns])
    ratio = F.greatest("a_score", "b_score") / F.least("a_score", "b_score")
    found = (
        similar.join(a.hint("merge"), F.col("a") == F.col("a_steam_app_id"))
        .join(b.hint("merge"), F.col("b") == F.col("b_steam_app_id"))
        .filter(ratio > above_ratio)
        .withColumn("ratio", F.round(ratio, 1))
    )
    text = F.format_string(
        INCONSISTENT_TEXT,
        "a_name",
        _shown(F.col("a_score")),
        "b_name",
        _shown(F.col("b_score")),
        "ratio",
        _shown(F.col("similarity_score")),
        _shown(F.col("genre")),
    )
    return found.select(
        *_finding("sales_inconsistency", F.col("a_name"), "Game", F.col("b_name"), text,
                  F.col("ratio"), high_above)
    )


def all_findings(*findings: DataFrame) -> DataFrame:
    stacked = findings[0]
    for more in findings[1:]:
        stacked = stacked.unionByName(more)
    return stacked


def replace_findings(findings: DataFrame, path: str, as_of: datetime | str | None = None) -> DataFrame:
    """Replace the stored anomaly table."""
    with_load_time(findings, as_of).write.mode("overwrite").parquet(path)
    return findings.sparkSession.read.parquet(path)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("anomaly_type", "severity").agg(F.count(F.lit(1)).alias("n"))
