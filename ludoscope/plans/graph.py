"""The property graph as node and edge DataFrames.

Edges to named nodes are (``src_id``, ``dst``, ``rel_type``): the app id of a game and the name of
the other node. Similarity edges are (``a``, ``b``, ``similarity_score``, ``genre``) between app ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered

# The similarity rule.
SIMILAR_NEXT = 5
SIMILAR_MAX_GAP = 0.30


# -- inputs ----------------------------------------------------------------------------------------


def graph_games(games: DataFrame) -> DataFrame:
    """Named games with the columns the graph needs."""
    return games.filter(text.filled(F.col("game_name"))).select(
        "steam_app_id",
        "game_name",
        "developer",
        "publisher",
        F.col("primary_genre_final").alias("genre"),
        "igdb_genres",
        "platforms",
        "themes",
        "tags",
        "review_score",
        "review_label",
        "owners_estimate",
        "popularity_score",
        "popularity_tier",
        "price_usd",
        "price_tier",
        F.col("concurrent_users").alias("ccu"),
        "avg_playtime_hours",
        "release_date",
    )


def graph_genres(genre_stats: DataFrame) -> DataFrame:
    return genre_stats.select(
        "genre", "market_share_pct", "avg_review_score", "num_games", "total_owners", "positive_rate_pct"
    )


def graph_publishers(publisher_stats: DataFrame, top: int | None = None) -> DataFrame:
    """Statistics of all publishers, or of the ``top`` by owners."""
    if top is not None:
        # The ranks are 1..n without gaps, so the cap is a filter and needs no sort.
        publisher_stats = publisher_stats.filter(F.col("rank_by_owners") <= top)
    return publisher_stats.select(
        "publisher",
        F.col("market_share_games_pct").alias("market_share_pct"),
        F.col("rank_by_owners").alias("rank"),
        "num_games",
        "total_owners",
        "avg_review_score",
        "num_distinct_genres",
    )


# -- edges -----------------------------------------------------------------------------------------


def _edges(games: DataFrame, rel_type: str, targets) -> DataFrame:
    return (
        games.select(F.col("steam_app_id").alias("src_id"), F.explode(targets).alias("dst"))
        .distinct()
        .withColumn("rel_type", F.lit(rel_type))
    )


def edges_genre(games: DataFrame) -> DataFrame:
    named = games.filter(text.filled(F.col("genre")))
    return (
        named.select(F.col("steam_app_id").alias("src_id"), F.col("genre").alias("dst"))
        .distinct()
        .withColumn("rel_type", F.lit("BELONGS_TO"))
    )


def edges_developer(games: DataFrame) -> DataFrame:
    return _edges(games, "DEVELOPED_BY", text.split_csv(F.col("developer")))


def edges_publisher(games: DataFrame) -> DataFrame:
    """A company name that contains a comma falls apart into several publishers."""
    return _edges(games, "PUBLISHED_BY", text.split_csv(F.col("publisher")))


def edges_platform(games: DataFrame) -> DataFrame:
    return _edges(games, "AVAILABLE_ON", text.split_csv(F.col("platforms")))


def edges_theme(games: DataFrame) -> DataFrame:
    return _edges(games, "HAS_THEME", text.split_csv(F.col("themes")))


def edges_tag(games: DataFrame, per_game: int | None = None) -> DataFrame:
    """Edges to all tags of a game, or to its first ``per_game``."""
    return _edges(games, "TAGGED_WITH", text.split_csv(F.col("tags"), per_game))


def named_edges(games: DataFrame, tags_per_game: int | None = None) -> DataFrame:
    """All edges from games to named nodes; the games are read once."""
    kinds = {
        "BELONGS_TO": F.when(text.filled(F.col("genre")), F.array("genre")),
        "DEVELOPED_BY": text.split_csv(F.col("developer")),
        "PUBLISHED_BY": text.split_csv(F.col("publisher")),
        "AVAILABLE_ON": text.split_csv(F.col("platforms")),
        "HAS_THEME": text.split_csv(F.col("themes")),
        "TAGGED_WITH": text.split_csv(F.col("tags"), tags_per_game),
    }
    def tagged(kind: str, names):
        names = F.coalesce(names, F.array().cast("array<string>"))
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    targets = F.flatten(F.array(*[tagged(kind, names) for kind, names in kinds.items()]))
    return (
        games.select(F.col("steam_app_id").alias("src_id"), F.explode(targets).alias("t"))
        .select("src_id", F.col("t.name").alias("dst"), F.col("t.kind").alias("rel_type"))
        .distinct()
    )


def edges_similar(
    games: DataFrame,
    *,
    pool: int | None = None,
    following: int = SIMILAR_NEXT,
    max_gap: float = SIMILAR_MAX_GAP,
) -> DataFrame:
    """Each game of a genre with the ``following`` games after it by popularity, if close.

    ``pool`` keeps the edges within a genre's most popular games. The followers of a game come from its
    slice of the order and the slices behind it (``ordered``), so a genre that holds a large part of all
    games is not one task, and no game is joined with others.
    """
    scored = games.filter(text.filled(F.col("genre")) & (F.col("popularity_score") != 0)).select(
        "genre",
        F.col("steam_app_id").alias("a"),
        F.col("popularity_score").cast("decimal(18,6)").alias("high"),
    )
    # Records that agree in genre, score and id, if a title has several, are told apart by a number.
    numbered = scored.groupBy("genre", "a", "high").agg(F.count(F.lit(1)).alias("copies")).select(
        "genre", "a", "high", (-F.col("high")).alias("falling"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    )
    by, order = ["genre"], ["falling", "a", "copy"]
    ranked = ordered.sliced(numbered, by, order)
    after = ordered.neighbours(ranked, by, order, F.struct(F.col("a").alias("b"), F.col("high").alias("low")), "after", count=following)
    if pool is not None:
        after = ordered.row_number(after, by, order, "rn").filter(F.col("rn") < pool)
        after = after.withColumn("after", F.slice("after", 1, F.least(F.lit(pool) - F.col("rn"), F.lit(following)).cast("int")))
    pairs = after.select("genre", "a", "high", F.explode("after").alias("other")).select("genre", "a", "high", "other.*")
    close = (F.col("high") - F.col("low")) < F.col("high") * F.lit(str(max_gap)).cast("decimal(6,4)")
    edges = pairs.filter(close).select(
        "a",
        "b",
        F.round(F.col("low") / F.col("high"), 3).cast("double").alias("similarity_score"),
        "genre",
    )
    # One edge per direction and pair, even where the pair shares several genres.
    kept = F.max(F.struct("similarity_score", "genre")).alias("kept")
    return edges.groupBy("a", "b").agg(kept).select("a", "b", "kept.similarity_score", "kept.genre")


# -- nodes -----------------------------------------------------------------------------------------


def nodes_game(games: DataFrame) -> DataFrame:
    """One node per app id, taken from the record with the most ratings; missing numbers are 0."""

    def number(name: str, kind: str):
        return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)

    first = Window.partitionBy("steam_app_id").orderBy(
        F.col("igdb_rating_count").desc_nulls_last(), F.col("igdb_id").asc_nulls_last()
    )
    named = games.filter(text.filled(F.col("game_name")) & F.col("steam_app_id").isNotNull())
    one = named.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
    return one.withColumn("ccu", F.col("concurrent_users")).select(
        "steam_app_id",
        F.col("game_name").alias("name"),
        number("review_score", "double"),
        "review_label",
        number("owners_estimate", "bigint"),
        number("popularity_score", "double"),
        "popularity_tier",
        number("price_usd", "double"),
        "price_tier",
        number("ccu", "int"),
        number("avg_playtime_hours", "double"),
        F.col("release_date").cast("string").alias("release_date"),
        F.col("primary_genre_final").alias("primary_genre"),
    )


def _with_linked(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with statistics plus the nodes that only edges mention, whose attributes stay NULL."""
    linked = edges.select(F.col("dst").alias("name")).distinct()
    return stats.join(linked, "name", "full_outer")


def nodes_genre(genres: DataFrame, edges: DataFrame) -> DataFrame:
    zero = {"market_share_pct": 0.0, "avg_review_score": 0.0, "num_games": 0, "total_owners": 0}
    stats = (
        genres.filter(text.filled(F.col("genre")))
        .withColumnRenamed("genre", "name")
        .fillna({**zero, "positive_rate_pct": 0.0})
    )
    return _with_linked(stats, edges)


def nodes_publisher(publishers: DataFrame, edges: DataFrame) -> DataFrame:
    stats = (
        publishers.filter(text.filled(F.col("publisher")))
        .withColumnRenamed("publisher", "name")
        .fillna(0)
    )
    return _with_linked(stats, edges)


def nodes_other(edges: DataFrame) -> DataFrame:
    """Developer, Platform, Theme and Tag nodes, which exist through their edges only."""
    # Label of the nodes an edge type leads to.
    labels = {
        "DEVELOPED_BY": "Developer",
        "AVAILABLE_ON": "Platform",
        "HAS_THEME": "Theme",
        "TAGGED_WITH": "Tag",
    }
    label = F
    for rel_type, name in labels.items():
        label = label.when(F.col("rel_type") == rel_type, name)
    return (
        edges.filter(F.col("rel_type").isin(*labels))
        .select(label.alias("label"), F.col("dst").alias("name"))
        .distinct()
    )


def merged(kept: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    """Load without wiping: fresh rows replace kept ones of the same key, other kept rows stay."""
    # By sorting, since edges and nodes in compressed files look small enough to go through the driver.
    return kept.join(fresh.select(*key).hint("merge"), list(key), "left_anti").unionByName(fresh)


def graph_stats(
    game_nodes: DataFrame,
    genre_nodes: DataFrame,
    publisher_nodes: DataFrame,
    other_nodes: DataFrame,
    edges: DataFrame,
    similar: DataFrame,
) -> DataFrame:
    """Nodes per label and edges per type: ``kind``, ``name``, ``n``."""

    def labelled(df: DataFrame, kind: str, name) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.alias("name"))

    rows = labelled(game_nodes, "node", F.lit("Game"))
    for part in (
        labelled(genre_nodes, "node", F.lit("Genre")),
        labelled(publisher_nodes, "node", F.lit("Publisher")),
        labelled(other_nodes, "node", F.col("label")),
        labelled(edges, "edge", F.col("rel_type")),
        labelled(similar, "edge", F.lit("SIMILAR_TO")),
    ):
        rows = rows.unionByName(part)
    return (
        rows.groupBy("kind", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("kind").desc(), F.col("n").desc(), "name")
    )


def similar_games(similar: DataFrame, nodes: DataFrame, app_id: int, limit: int = 10) -> DataFrame:
    """Neighbours of one game over similarity edges in either direction, closest first."""
    out = similar.filter(F.col("a") == app_id).select(
        F.col("b").alias("steam_app_id"), "similarity_score", "genre"
    )
    back = similar.filter((F.col("b") == app_id) & (F.col("a") != app_id)).select(
        F.col("a").alias("steam_app_id"), "similarity_score", "genre"
    )
    return (
        out.unionByName(back)
        .join(nodes, "steam_app_id")
        .select(
            "steam_app_id",
            F.col("name").alias("game_name"),
            "popularity_tier",
            "popularity_score",
            F.col("similarity_score").alias("similarity"),
            F.col("genre").alias("shared_genre"),
        )
        .orderBy(F.col("similarity").desc(), "steam_app_id")
        .limit(limit)
    )
