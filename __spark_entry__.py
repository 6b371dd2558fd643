
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludoscope.fixtures import adapters as fx
from ludoscope.fixtures import oracle
from ludoscope.functions import text
from ludoscope.operators import live, normalize, play_sessions, quality, requests, sliding, staging, subtotals, windows
from ludoscope.plans import anomalies, dashboard, graph, marts, reports
from ludoscope.plans.materialise import stored
from ludoscope.session import prepare
from ludoscope.sources import catalogs, tables, topics

documents = corpus_pipeline = None
try:  # the document operators are an optional part
    import ludoscope.llm.queries as documents

    import corpus_pipeline
except ModuleNotFoundError as missing:
    if missing.name not in ("ludoscope.llm", "ludoscope.llm.queries", "corpus_pipeline"):
        raise

SMOKE_DIR = "/root/testdata/sf0.001"
PRICE_DAYS = 7
LOWERED = {"above_pct": 5, "high_above_pct": 6}
ISOLATED = {"min_owners": 100, "min_score": 20, "high_above": 90}
# Scores of neighbours in the popularity order lie close, so games are isolated within a narrow gap only.
ISOLATED_GAP = 0.001
# Ids that exist in the test tables: a catalogue entry, a game with neighbours, one with events.
GAME_ID, LINKED_GAME_ID, PLAYED_GAME_ID = oracle.GAME_ID, oracle.LINKED_GAME_ID, oracle.PLAYED_GAME_ID


def _plain(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times, so that no client time zone shifts them."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    return df


# -- shared inputs of the registered queries -------------------------------------------------------


def _stored_games(spark, d):
    """The games mart as a stored table, which the queries over marts and graph read."""
    return fx.warehouse(spark, d, "mart-games", fx.games)


def _trending(spark, d, lookback_days=marts.LOOKBACK_DAYS, games=None):
    activity = marts.recent_activity(
        *fx.all_staged_windows(spark, d, lookback_days),
        as_of=fx.AS_OF,
        lookback_days=lookback_days,
    )
    return marts.mart_trending(games or _stored_games(spark, d), activity, lookback_days=lookback_days)


def _reviews(spark, d, games=None):
    return marts.mart_review_analysis(
        games or _stored_games(spark, d), fx.staged_windows(spark, d, "reviews", marts.LOOKBACK_DAYS), as_of=fx.AS_OF
    )


def _sessions(spark, d, games=None):
    return marts.mart_session_analysis(
        games or _stored_games(spark, d), fx.staged_windows(spark, d, "sessions", marts.LOOKBACK_DAYS), as_of=fx.AS_OF
    )


def _prices(spark, d, games=None):
    return marts.mart_price_analysis(
        games or _stored_games(spark, d),
        fx.staged_windows(spark, d, "purchases", PRICE_DAYS),
        as_of=fx.AS_OF,
        hours=PRICE_DAYS * 24,
    )


def _genres(spark, d, games=None):
    return marts.mart_genre_stats(games or _stored_games(spark, d))


def _publishers(spark, d, games=None):
    return marts.mart_publisher_stats(games or _stored_games(spark, d))


def _mart(spark, d, name):
    """A mart as the daily run leaves it: built once, then read."""
    builders = {
        "trending": _trending, "genres": _genres, "publishers": _publishers, "reviews": _reviews,
        "sessions": _sessions, "prices": _prices, "findings": _findings, "flagged": _flagged,
    }
    return fx.warehouse(spark, d, f"mart-{name}", builders[name])


def _marts(spark, d, *names):
    """Marts that do not read each other, built side by side: one alone leaves cores idle between its stages."""
    _stored_games(spark, d)
    with ThreadPoolExecutor(len(names)) as pool:
        # Each has its own copy of the thread's properties, which hold the number of the running query.
        building = [pool.submit(inheritable_thread_target(lambda n=n: _mart(spark, d, n))) for n in names]
    return [one.result() for one in building]


def shared_tables(spark: SparkSession, sf_dir: str) -> None:
    """Build the tables that several registered queries read, as the daily run leaves them."""
    _stored_games(prepare(spark), sf_dir)
    for name in ("trending", "genres", "publishers", "findings", "flagged"):
        _mart(spark, sf_dir, name)


def _graph_games(spark, d):
    return graph.graph_games(_stored_games(spark, d))


def _neighbours(games):
    similar = graph.edges_similar(graph.graph_games(games))
    return graph.similar_games(similar, graph.nodes_game(games), LINKED_GAME_ID, 50)


def _genre_nodes(spark, d, games):
    edges = graph.edges_genre(graph.graph_games(games))
    return graph.nodes_genre(graph.graph_genres(_mart(spark, d, "genres")), edges)


def _publisher_nodes(spark, d, games):
    edges = graph.edges_publisher(graph.graph_games(games))
    stats = graph.graph_publishers(_mart(spark, d, "publishers"))
    return graph.nodes_publisher(stats, edges)


def _other_nodes(games):
    return graph.nodes_other(graph.named_edges(graph.graph_games(games)))


def _graph_stats(spark, d):
    games = _stored_games(spark, d)
    named = graph.graph_games(games)
    return graph.graph_stats(
        graph.nodes_game(games),
        _genre_nodes(spark, d, games),
        _publisher_nodes(spark, d, games),
        _other_nodes(games),
        graph.named_edges(named),
        graph.edges_similar(named),
    )


def _graph_inputs(spark, d):
    """The three graph inputs in one shape."""
    games = _stored_games(spark, d)

    def shape(df, kind, name, owners):
        return df.select(
            F.lit(kind).alias("input"), F.col(name).alias("name"), F.col(owners).alias("owners")
        )

    publishers = graph.graph_publishers(_mart(spark, d, "publishers"))
    return (
        shape(graph.graph_games(games), "game", "game_name", "owners_estimate")
        .unionByName(shape(graph.graph_genres(_mart(spark, d, "genres")), "genre", "genre", "total_owners"))
        .unionByName(shape(publishers, "publisher", "publisher", "total_owners"))
    )


def _dominance(games):
    named = graph.graph_games(games)
    return anomalies.publisher_dominance(
        graph.edges_publisher(named), graph.edges_genre(named), **LOWERED
    )


def _old_edges(games):
    """Similarity edges as an earlier load left them, when scores were the review scores."""
    return graph.edges_similar(
        graph.graph_games(games).withColumn("popularity_score", F.col("review_score"))
    )


def _merged_edges(games):
    """A load without a wipe: fresh edges over those an earlier load left."""
    fresh = graph.edges_similar(graph.graph_games(games))
    return graph.merged(_old_edges(games), fresh, "a", "b")


def _isolated(games):
    close = graph.edges_similar(graph.graph_games(games), max_gap=ISOLATED_GAP)
    return anomalies.isolated_games(graph.nodes_game(games), close, **ISOLATED)


def _inconsistent(games):
    return anomalies.sales_inconsistency(_old_edges(games), graph.nodes_game(games))


def _findings(spark, d, games=None):
    games = games or _stored_games(spark, d)
    return anomalies.all_findings(_dominance(games), _isolated(games), _inconsistent(games))


def _flagged(spark, d):
    return reports.flagged_windows(*fx.all_staged_windows(spark, d))


def _histories(spark, d, granularity="day", days=14):
    built = (
        reports.purchase_history,
        reports.review_history,
        reports.session_history,
        reports.wishlist_history,
    )
    return [
        history(fx.windows(spark, d, topic, days=days), granularity, days, fx.AS_OF)
        for topic, history in zip(topics.TOPICS, built)
    ]


def _history(index: int, granularity: str, days: int):
    return lambda spark, d: _histories(spark, d, granularity, days)[index]


def _loaded(df):
    return tables.with_load_time(df, fx.AS_OF)


def _mart_tables(spark, d):
    kinds = ("trending", "genres", "publishers", "prices", "reviews", "sessions")
    trending, genres, publishers, prices, reviews, sessions = _marts(spark, d, *kinds)
    return {
        "igdb_games": fx.catalog_a(spark, d),
        "steamspy_games": fx.catalog_b(spark, d),
        "mart_games": _stored_games(spark, d),
        "mart_trending_games": trending,
        "mart_genre_stats": genres,
        "mart_publisher_stats": publishers,
        "mart_price_analysis": prices,
        "mart_review_analysis": reviews,
        "mart_session_analysis": sessions,
    }


def _node_keys(spark, d):
    games = _stored_games(spark, d)
    other = stored(_other_nodes(games), "other-nodes")
    frames = {
        "Game": graph.nodes_game(games),
        "Genre": _genre_nodes(spark, d, games),
        "Publisher": _publisher_nodes(spark, d, games),
    }
    for label in ("Developer", "Platform", "Theme", "Tag"):
        frames[label] = other.filter(F.col("label") == label)
    return quality.check_unique(frames, quality.NODE_KEYS)


def _totals(metric):
    return {"n": F.count(F.lit(1)), "total": F.sum(F.col(metric).cast("decimal(20,6)")).cast("double")}


def _home(spark, d):
    return dashboard.home_kpis(
        {
            "games": _stored_games(spark, d),
            "trending": _mart(spark, d, "trending"),
            "graph_anomalies": _mart(spark, d, "findings"),
            "stream_anomalies": _mart(spark, d, "flagged"),
        }
    )


def _part_texts(spark, d):
    """Range, price and tag texts in several spellings, one row per part."""
    key = F.col("p_partkey")
    low, high = F.format_number(key * 1000, 0), F.format_number(key * 1000 + 2001, 0)
    return fx.table(spark, d, "part").select(
        "p_partkey",
        F.when(key % 10 == 0, F.lit(None))
        .when(key % 10 == 1, "")
        .when(key % 10 == 2, "a .. b")
        .when(key % 10 == 3, low)
        .otherwise(F.concat_ws(" .. ", low, high))
        .alias("owners"),
        F.when(key % 10 == 0, F.lit(None))
        .when(key % 10 == 1, "")
        .when(key % 10 == 2, "x")
        .otherwise(key.cast("string"))
        .alias("cents"),
        F.when(key % 6 == 0, F.lit(None))
        .when(key % 6 == 1, F.to_json(F.map_from_arrays(F.array("p_type", "p_brand"), F.array(F.lit(2), F.lit(1)))))
        .when(key % 6 == 2, F.to_json(F.array("p_type", "p_brand")))
        .when(key % 6 == 3, "{}")
        .when(key % 6 == 4, "[]")
        .otherwise(F.col("p_name"))
        .alias("tags"),
    )


def _parsed_pages(pages):
    records = catalogs.explode_pages(pages)
    return records.select("page", "appid", "name", "developer", "publisher", "owners", "price", "positive", "negative", "genre")


def _enriched(spark, d, first=500):
    b = fx.catalog_b(spark, d)
    key = F.col("p_partkey")
    details = fx.table(spark, d, "part").select(
        key.cast("int").alias("appid"),
        F.when(key % 4 == 0, F.concat(F.lit("detail of "), "p_name")).otherwise("").alias("tags"),
        F.when(key % 2 == 0, "English, French").alias("languages"),
        F.lit(None).cast("string").alias("genre"),
    )
    return normalize.enrich_details(b, details, first=first).select("appid", "tags", "languages", "genre")


# -- the contract ----------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Trending games of the test events."""
    return _plain(reports.list_trending(_trending(prepare(spark), SMOKE_DIR), limit=50))


def _registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    s: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    # Sources and sinks
    s["topic_parse"] = lambda k, d: topics.parse_messages(fx.messages(k, d, "purchases"), "purchases")
    for topic in ("reviews", "sessions", "wishlist"):
        s[f"topic_parse_{topic}"] = lambda k, d, t=topic: topics.parse_messages(fx.messages(k, d, t), t)
    s["catalog_top_rated"] = lambda k, d: catalogs.top_rated(
        catalogs.parse_catalog_a(fx.raw_records_a(k, d)), 500
    ).select("id", "name", "rating", "rating_count")
    s["catalog_rated"] = lambda k, d: catalogs.top_rated(
        catalogs.parse_catalog_a(fx.raw_records_a(k, d))
    ).select("id", "name", "rating", "rating_count")
    s["catalog_pages_explode"] = lambda k, d: _parsed_pages(fx.raw_pages_b(k, d))
    s["catalog_pages_with_bad"] = lambda k, d: _parsed_pages(fx.damaged_pages_b(k, d)).select("page", "appid")
    s["catalog_page_rejects"] = lambda k, d: catalogs.rejected_pages(fx.damaged_pages_b(k, d))
    s["write_dated"] = fx.rewritten_day
    s["load_agg_incremental"] = fx.loaded_windows
    s["load_events_incremental"] = lambda k, d: fx.loaded_events(k, d, "purchases")
    for topic in ("reviews", "sessions", "wishlist"):
        s[f"load_events_incremental_{topic}"] = lambda k, d, t=topic: fx.loaded_events(k, d, t)
    s["load_catalog_full_refresh"] = fx.refreshed_catalog
    s["load_rejects"] = fx.rejected_events
    s["load_audit_counts"] = lambda k, d: tables.audit_counts(
        {
            "IGDB_GAMES": fx.catalog_a(k, d),
            "STEAMSPY_GAMES": fx.catalog_b(k, d),
            **{f"STREAM_{t.upper()}": fx.topic(k, d, t) for t in topics.TOPICS},
        }
    )
    s["message_rejects"] = fx.unreadable_messages
    s["graph_inputs"] = _graph_inputs

    # Catalogue normalisation
    s["flatten_catalog_a"] = lambda k, d: normalize.flatten_catalog_a(
        catalogs.parse_catalog_a(fx.raw_records_a(k, d))
    )
    s["flatten_catalog_b"] = lambda k, d: normalize.flatten_catalog_b(
        catalogs.explode_pages(fx.raw_pages_b(k, d))
    )
    s["owners_midpoint"] = lambda k, d: _part_texts(k, d).select(
        "p_partkey", text.owners_midpoint(F.col("owners")).alias("owners_estimate")
    )
    s["cents_to_dollars"] = lambda k, d: _part_texts(k, d).select(
        "p_partkey", text.cents_to_dollars(F.col("cents")).alias("price_usd")
    )
    s["tags_to_string"] = lambda k, d: _part_texts(k, d).select(
        "p_partkey", text.tags_to_string(F.col("tags")).alias("tags")
    )
    s["enrich_details"] = _enriched
    s["enrich_details_all"] = lambda k, d: _enriched(k, d, None)

    # Windows, at the length the stream uses and as streams
    for topic in topics.TOPICS:
        s[f"win_{topic}"] = lambda k, d, t=topic: fx.windows(k, d, t, windows.WINDOW)
        s[f"stream_{topic}"] = lambda k, d, t=topic: fx.streamed_windows(k, d, t)
        s[f"stream_late_{topic}"] = lambda k, d, t=topic: fx.streamed_deliveries(k, d, t)
    s["raw_events"] = lambda k, d: fx.streamed_raw(k, d, "sessions")
    for topic in ("purchases", "reviews", "wishlist"):
        s[f"raw_events_{topic}"] = lambda k, d, t=topic: fx.streamed_raw(k, d, t)
    s["raw_events_since"] = fx.raw_since
    s["win_purchases_odd_prices"] = lambda k, d: windows.aggregate_windows(fx.odd_prices(k, d), "purchases", window=fx.DAY)
    s["stg_purchases_odd_prices"] = lambda k, d: staging.stage_purchases(_loaded(fx.odd_prices(k, d))).select("event_id", "revenue_net_usd")
    for topic in topics.TOPICS:
        s[f"win_sliding_{topic}"] = lambda k, d, t=topic: sliding.sliding_windows(fx.topic(k, d, t), t)
        s[f"live_state_expiring_{topic}"] = lambda k, d, t=topic: fx.expiring_live(k, d, t)
        s[f"stream_unique_{topic}"] = lambda k, d, t=topic: fx.streamed_unique(k, d, t)
    s["unique_purchases"] = lambda k, d: fx.unique(k, d, "purchases")
    s["play_sessions"] = lambda k, d: play_sessions.play_sessions(
        fx.topic(k, d, "sessions"), gap_seconds=fx.DAY_SECONDS, by=("user_id",)
    )
    s["stream_play_sessions"] = fx.streamed_sessions
    s["purchase_reviews"] = fx.matches
    s["stream_purchase_reviews"] = fx.streamed_matches

    # Order and time
    s["price_in_force"] = fx.price_in_force
    s["campaign_events"] = fx.campaign_events
    s["campaign_overlaps"] = fx.campaign_overlaps
    s["purchase_gaps"] = fx.purchase_gaps
    s["owner_deciles"] = lambda k, d: fx.owner_deciles(_stored_games(k, d))
    s["load_change"] = fx.load_change
    s["players_from_sketches"] = fx.players
    s["agg_latest_version"] = lambda k, d: windows.latest_version(fx.update_mode_versions(k, d))

    # Staging
    s["stg_catalog_a"] = lambda k, d: staging.stage_catalog_a(_loaded(fx.catalog_a(k, d)))
    s["stg_catalog_b"] = lambda k, d: staging.stage_catalog_b(_loaded(fx.catalog_b(k, d)))
    s["price_tier"] = lambda k, d: staging.stage_catalog_b(fx.catalog_b(k, d)).select(
        "steam_app_id", "price_usd", "price_tier"
    )
    s["review_label"] = lambda k, d: staging.stage_catalog_b(fx.catalog_b(k, d)).select(
        "steam_app_id", "review_score", "review_label"
    )
    s["stg_purchases"] = lambda k, d: staging.stage_purchases(_loaded(fx.topic(k, d, "purchases")))
    s["stg_reviews"] = lambda k, d: staging.stage_reviews(_loaded(fx.topic(k, d, "reviews")))
    s["stg_sessions"] = lambda k, d: staging.stage_sessions(_loaded(fx.topic(k, d, "sessions")))
    s["stg_wishlist"] = lambda k, d: staging.stage_wishlist(_loaded(fx.topic(k, d, "wishlist")))
    for topic in topics.TOPICS:
        s[f"stg_{topic}_agg"] = lambda k, d, t=topic: fx.staged_windows(k, d, t).drop("loaded_at")

    # Marts
    s["mart_games"] = fx.games
    s["mart_games_all_records"] = lambda k, d: fx.games(k, d, dedupe=False)
    s["popularity_score"] = lambda k, d: _stored_games(k, d).select(
        "steam_app_id", "igdb_id", "popularity_score", "popularity_tier"
    )
    s["popularity_tier"] = lambda k, d: _stored_games(k, d).groupBy("popularity_tier").agg(
        F.count(F.lit(1)).alias("num_games"),
        F.min("popularity_score").alias("lowest"),
        F.max("popularity_score").alias("highest"),
    )
    s["mart_genre_stats"] = _genres
    s["mart_publisher_stats"] = _publishers
    s["mart_price_analysis"] = _prices
    s["mart_review_analysis"] = _reviews
    s["mart_session_analysis"] = _sessions
    s["mart_trending"] = _trending
    s["mart_trending_lookback"] = lambda k, d: _trending(k, d, 7)

    # Graph
    s["nodes_genre"] = lambda k, d: _genre_nodes(k, d, _stored_games(k, d))
    s["nodes_publisher"] = lambda k, d: _publisher_nodes(k, d, _stored_games(k, d))
    s["nodes_game"] = lambda k, d: graph.nodes_game(_stored_games(k, d))
    s["split_csv"] = lambda k, d: _graph_games(k, d).select(
        "steam_app_id", F.explode(text.split_csv(F.col("tags"))).alias("tag")
    )
    for kind in ("genre", "developer", "publisher", "platform", "theme", "tag", "similar"):
        s[f"edges_{kind}"] = lambda k, d, build=getattr(graph, f"edges_{kind}"): build(_graph_games(k, d))
    s["nodes_other"] = lambda k, d: _other_nodes(_stored_games(k, d))
    s["graph_stats"] = _graph_stats
    s["anom_publisher_dominance"] = lambda k, d: _dominance(_stored_games(k, d))
    s["anom_isolated"] = lambda k, d: _isolated(_stored_games(k, d))
    s["anom_inconsistency"] = lambda k, d: _inconsistent(_stored_games(k, d))
    s["graph_merged"] = lambda k, d: _merged_edges(_stored_games(k, d))
    s["kg_anomalies"] = lambda k, d: fx.stored_findings(k, d, _findings(k, d))
    s["anomaly_summary"] = lambda k, d: anomalies.summary(_mart(k, d, "findings"))
    s["similar_games"] = lambda k, d: _neighbours(_stored_games(k, d))

    # Read queries
    s["q_games"] = lambda k, d: reports.list_games(
        _stored_games(k, d), min_owners=100, genre="econ", tier="mid"
    )
    s["q_game"] = lambda k, d: reports.get_game(_stored_games(k, d), GAME_ID)
    s["q_genres"] = lambda k, d: reports.list_genres(_mart(k, d, "genres"), 4)
    s["q_publishers"] = lambda k, d: reports.list_publishers(_mart(k, d, "publishers"), 20)
    s["q_trending"] = lambda k, d: reports.list_trending(_mart(k, d, "trending"), only_anomalies=True)
    s["q_stream_anomalies"] = lambda k, d: reports.stream_anomalies(_mart(k, d, "flagged"), 200)
    s["q_graph_anomalies"] = lambda k, d: reports.graph_anomalies(
        _mart(k, d, "findings"), anomaly_type="isolated_game", severity="High", limit=20
    )
    s["q_reviews"] = lambda k, d: reports.review_report(_mart(k, d, "reviews"))
    s["q_sessions"] = lambda k, d: reports.session_report(_mart(k, d, "sessions"))
    s["q_prices"] = lambda k, d: reports.price_report(_mart(k, d, "prices"))
    s["live_state"] = fx.live
    s["live_state_stream"] = lambda k, d: fx.streamed_live(k, d, "purchases")
    for topic in ("reviews", "sessions", "wishlist"):
        s[f"live_state_stream_{topic}"] = lambda k, d, t=topic: fx.streamed_live(k, d, t)
    s["live_hash"] = lambda k, d: live.as_hash(fx.live(k, d)).select(
        "key", *[F.element_at("data", name).alias(name) for name in ("game_id", "num_purchases", "num_reviews", "num_starts", "net_added")]
    )
    s["q_live_stat"] = lambda k, d: live.live_stat(fx.live(k, d), "purchases", PLAYED_GAME_ID)
    s["q_live_all"] = lambda k, d: live.live_all(fx.live(k, d), "reviews", 50)
    s["hist_purchases"] = _history(0, "hour", 14)
    s["hist_reviews"] = _history(1, "day", 14)
    s["hist_sessions"] = _history(2, "week", 30)
    s["hist_wishlist"] = _history(3, "month", 30)

    # Dashboard
    s["kpi_home"] = _home
    s["kpi_live"] = lambda k, d: dashboard.live_kpis(fx.live(k, d))
    s["kpi_pulse"] = lambda k, d: dashboard.live_pulse(fx.live(k, d))
    s["top_n_live"] = lambda k, d: dashboard.live_top(fx.live(k, d))
    s["anomaly_type_counts"] = lambda k, d: dashboard.anomaly_type_counts(_mart(k, d, "flagged"))
    s["findings_subtotals"] = lambda k, d: subtotals.all_subtotals(
        _mart(k, d, "findings"), "anomaly_type", "severity", "related_entity", **_totals("metric_value")
    )
    s["flagged_rollup"] = lambda k, d: subtotals.rolled_up(
        _mart(k, d, "flagged"), "anomaly_type", "steam_app_id", **_totals("metric_2")
    )
    s["severity_kpis"] = lambda k, d: dashboard.severity_kpis(_mart(k, d, "findings"))
    s["anomaly_hierarchy"] = lambda k, d: dashboard.anomaly_hierarchy(_mart(k, d, "findings"))
    s["genre_totals"] = lambda k, d: dashboard.genre_totals(_mart(k, d, "genres"))
    s["hist_kpis"] = lambda k, d: dashboard.history_kpis(*_histories(k, d))
    s["trending_podium"] = lambda k, d: dashboard.trending_podium(_mart(k, d, "trending"))
    s["top_trending"] = lambda k, d: dashboard.top_trending(_mart(k, d, "trending"))
    s["top_genres"] = lambda k, d: dashboard.top_genres(_mart(k, d, "genres"))

    # Data quality
    s["dq_not_null"] = lambda k, d: quality.check_not_null(_mart_tables(k, d))
    s["dq_unique"] = lambda k, d: quality.check_unique(_mart_tables(k, d))
    s["dq_accepted_values"] = lambda k, d: quality.check_accepted_values(
        {"mart_games": _stored_games(k, d)}
    )
    s["dq_node_keys"] = _node_keys

    # Request log
    s["req_total"] = lambda k, d: requests.total_requests(fx.request_log(k, d))
    s["req_rate"] = lambda k, d: requests.request_rate(fx.request_log(k, d))
    s["req_rate_by_handler"] = lambda k, d: requests.request_rate(fx.request_log(k, d), "handler")
    s["req_rate_by_status"] = lambda k, d: requests.request_rate(fx.request_log(k, d), "status")
    s["req_error_rate"] = lambda k, d: requests.error_rate(fx.request_log(k, d))
    s["req_latency_pct"] = lambda k, d: requests.latency_quantiles(fx.request_log(k, d))
    s["req_latency_p99_by_handler"] = lambda k, d: requests.latency_quantiles(
        fx.request_log(k, d), "handler", quantiles=(0.99,)
    )
    s["req_latency_from_sketches"] = fx.day_latency
    s["req_latency_percentile"] = lambda k, d: requests.latency_percentiles(
        fx.request_log(k, d), window="1 day"
    )
    return s



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every implemented operator over the tables in ``sf_dir``."""

    def plain(build):
        return lambda spark, sf_dir: _plain(build(prepare(spark), sf_dir))

    found = {name: plain(build) for name, build in _registered().items()}
    if documents:
        found |= documents.queries()
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB's SQL, where it can express them."""
    found = oracle.statements()
    if documents:
        found |= documents.oracle_sql()
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
