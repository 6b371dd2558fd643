"""The daily run: staging views, mart tables, graph tables and findings from the loaded tables.

Staging results are views and cost nothing until read. Marts are tables: the games mart is read by
all others, so each is written once and the next ones start from its files.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators import quality, staging
from . import anomalies, graph, marts
from .materialise import as_table, as_view


@dataclass
class Loaded:
    """The loaded tables a daily run starts from."""

    catalog_a: DataFrame
    catalog_b: DataFrame
    events: dict[str, DataFrame]
    windows: dict[str, DataFrame]


def staging_views(loaded: Loaded, **limits: dict) -> dict[str, DataFrame]:
    """The ten staging views; ``limits`` gives flag limits per topic, e.g. ``purchases={...}``."""
    events, windows = loaded.events, loaded.windows
    views = {
        "stg_igdb_games": staging.stage_catalog_a(loaded.catalog_a),
        "stg_steamspy_games": staging.stage_catalog_b(loaded.catalog_b),
        "stg_stream_purchases": staging.stage_purchases(events["purchases"]),
        "stg_stream_reviews": staging.stage_reviews(events["reviews"]),
        "stg_stream_sessions": staging.stage_sessions(events["sessions"]),
        "stg_stream_wishlist": staging.stage_wishlist(events["wishlist"]),
    }
    stage_windows = {
        "purchases": staging.stage_purchase_windows,
        "reviews": staging.stage_review_windows,
        "sessions": staging.stage_session_windows,
        "wishlist": staging.stage_wishlist_windows,
    }
    for topic, stage in stage_windows.items():
        views[f"stg_stream_{topic}_agg"] = stage(windows[topic], **limits.get(topic, {}))
    return {name: as_view(df, name) for name, df in views.items()}


def mart_tables(
    views: dict[str, DataFrame],
    root: str,
    *,
    as_of: datetime | str | None = None,
    lookback_days: int = marts.LOOKBACK_DAYS,
    dedupe: bool = True,
) -> dict[str, DataFrame]:
    """Write the seven marts below ``root`` and read them back."""
    p, r, s, w = (
        views[f"stg_stream_{t}_agg"] for t in ("purchases", "reviews", "sessions", "wishlist")
    )
    games = as_table(
        marts.mart_games(views["stg_steamspy_games"], views["stg_igdb_games"], dedupe=dedupe),
        root,
        "mart_games",
        cluster_by="steam_app_id",
    )
    recent = {"as_of": as_of, "lookback_days": lookback_days}
    plans = {
        "mart_genre_stats": lambda: marts.mart_genre_stats(games),
        "mart_publisher_stats": lambda: marts.mart_publisher_stats(games),
        "mart_price_analysis": lambda: marts.mart_price_analysis(games, p, as_of=as_of),
        "mart_review_analysis": lambda: marts.mart_review_analysis(games, r, **recent),
        "mart_session_analysis": lambda: marts.mart_session_analysis(games, s, **recent),
        "mart_trending_games": lambda: marts.mart_trending(
            games, marts.recent_activity(p, r, s, w, **recent), lookback_days=lookback_days
        ),
    }
    written = {name: as_table(plan(), root, name) for name, plan in plans.items()}
    return {"mart_games": games, **written}


def graph_tables(
    tables: dict[str, DataFrame], root: str, *, kept: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Write nodes and edges below ``root``.

    ``kept`` holds the tables of an earlier load, which must lie elsewhere: their rows stay unless
    this load has a row of the same key. Without it the graph starts empty.
    """
    games = tables["mart_games"]
    named = graph.graph_games(games)
    links = as_table(
        _with_kept(graph.named_edges(named), kept, "edges", "src_id", "dst", "rel_type"), root, "edges"
    )
    genres = graph.graph_genres(tables["mart_genre_stats"])
    publishers = graph.graph_publishers(tables["mart_publisher_stats"])

    def of(rel_type: str) -> DataFrame:
        return links.filter(links.rel_type == rel_type)

    plans = {
        "nodes_game": (graph.nodes_game(games), ("steam_app_id",)),
        "nodes_genre": (graph.nodes_genre(genres, of("BELONGS_TO")), ("name",)),
        "nodes_publisher": (graph.nodes_publisher(publishers, of("PUBLISHED_BY")), ("name",)),
        "nodes_other": (graph.nodes_other(links), ("label", "name")),
        "similar": (graph.edges_similar(named), ("a", "b")),
    }
    written = {
        name: as_table(_with_kept(df, kept, name, *key), root, name)
        for name, (df, key) in plans.items()
    }
    return {"edges": links, **written}


def _with_kept(fresh: DataFrame, kept: dict[str, DataFrame] | None, name: str, *key: str) -> DataFrame:
    return graph.merged(kept[name], fresh, *key) if kept and name in kept else fresh


def findings_table(
    tables: dict[str, DataFrame], path: str, as_of: datetime | str | None = None
) -> DataFrame:
    """Replace the anomaly table by what the three detectors find in the stored graph."""
    edges, nodes, similar = tables["edges"], tables["nodes_game"], tables["similar"]
    found = anomalies.all_findings(
        anomalies.publisher_dominance(
            edges.filter(edges.rel_type == "PUBLISHED_BY"), edges.filter(edges.rel_type == "BELONGS_TO")
        ),
        anomalies.isolated_games(nodes, similar),
        anomalies.sales_inconsistency(similar, nodes),
    )
    return anomalies.replace_findings(found, path, as_of)


def check_tables(loaded: Loaded, tables: dict[str, DataFrame]) -> DataFrame:
    """Failing rows per check over the catalogues and the marts."""
    checked = {"igdb_games": loaded.catalog_a, "steamspy_games": loaded.catalog_b, **tables}
    checked = {name: df for name, df in checked.items() if name in quality.KEYS}
    return (
        quality.check_not_null(checked)
        .unionByName(quality.check_unique(checked))
        .unionByName(quality.check_accepted_values(checked))
    )
