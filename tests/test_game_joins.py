"""Joins of games do not go through the driver, however small the compressed files look to the planner."""

from datetime import datetime

import __spark_entry__ as entry
import pytest
from helpers import frame, plan_of, rows
from ludoscope.plans import anomalies, dashboard, graph, marts
from ludoscope.plans.materialise import stored
from test_marts_graph import A_DDL, B_DDL, NODE_DDL, a_row, b_row

SMALL = "/root/testdata/sf0.001"


def files(spark, ddl, data):
    """Rows read from files, whose size the planner knows."""
    return stored(frame(spark, ddl, data), "test")


def test_isolated_games_are_found_by_a_sorted_join(spark):
    nodes = files(spark, NODE_DDL, [(k, f"g{k}", 200_000, 70.0, "hit") for k in range(1, 5)])
    similar = files(spark, "a int, b int", [(1, 2), (2, 1), (2, 4)])
    found = anomalies.isolated_games(nodes, similar)
    plan = plan_of(found)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert rows(found.select("entity_name")) == [("g3",)]


@pytest.mark.parametrize("dedupe", [True, False])
def test_titles_meet_by_a_sorted_join(spark, dedupe):
    b = files(spark, B_DDL, [b_row(1, "Doom"), b_row(2, "quake"), b_row(3, " ")])
    a = files(spark, A_DDL, [a_row(10, "DOOM", 1), a_row(11, "doom", 9), a_row(12, "")])
    games = marts.mart_games(b, a, dedupe=dedupe)
    plan = plan_of(games)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    want = [(1, 11), (2, None), (3, None)]
    assert rows(games.select("steam_app_id", "igdb_id")) == (want if dedupe else [(1, 10), *want])


def test_findings_join_games_by_sorting(spark):
    """Dominant publishers and inconsistent neighbours, the other parts of the findings."""
    by = files(spark, "src_id int, dst string", [(k, "P") for k in range(4)])
    genre = files(spark, "src_id int, dst string", [(k, "G") for k in range(5)])
    held = anomalies.publisher_dominance(by, genre)
    assert "BroadcastHashJoin" not in plan_of(held)
    assert rows(held.select("entity_name", "metric_value")) == [("P", 80.0)]
    nodes = files(spark, NODE_DDL, [(1, "a", 1, 90.0, "x"), (2, "b", 1, 10.0, "x")])
    edges = files(spark, "a int, b int, similarity_score double, genre string", [(1, 2, 0.9, "g")])
    odd = anomalies.sales_inconsistency(edges, nodes)
    assert "BroadcastHashJoin" not in plan_of(odd)
    assert rows(odd.select("entity_name", "metric_value")) == [("a", 9.0)]


def test_loads_without_a_wipe_merge_by_sorting(spark):
    ddl = "a int, b int, genre string"
    both = graph.merged(files(spark, ddl, [(1, 2, "old"), (1, 3, "old")]), files(spark, ddl, [(1, 2, "new")]), "a", "b")
    assert "BroadcastHashJoin" not in plan_of(both)
    assert rows(both) == [(1, 2, "new"), (1, 3, "old")]


GAMES_DDL = ("steam_app_id int, game_name string, developer string, publisher string, primary_genre_final string, owners_estimate bigint, "
             "popularity_score double, popularity_tier string, price_tier string, price_usd double, review_score double, review_label string, "
             "positive_reviews int, negative_reviews int, concurrent_users int, avg_playtime_hours double")


def activity(spark, columns, *values):
    return files(spark, f"window_start timestamp, steam_app_id int, {columns}", [(datetime(2024, 1, 1), 1, *values)])


def test_games_meet_their_activity_by_sorting(spark):
    games = files(spark, GAMES_DDL, [(k, f"g{k}", "d", "p", "G", 10, 1.0, "mid", "cheap", 1.0, 50.0, "mixed", 1, 1, 1, 1.0) for k in (1, 2)])
    p = activity(spark, "num_purchases bigint, revenue_net_usd double, is_viral boolean", 3, 6.0, False)
    r = activity(spark, "num_reviews bigint, avg_rating double, recommend_pct double, is_review_bomb boolean", 2, 5.0, 50.0, False)
    s = activity(spark, "num_starts bigint, num_ends bigint, avg_duration_sec double, is_ccu_spike boolean", 4, 2, 60.0, False)
    w = activity(spark, "net_added bigint, is_viral_wishlist boolean", 1, False)
    at = {"as_of": "2024-01-02"}
    trending = marts.mart_trending(games, marts.recent_activity(p, r, s, w, **at))
    of = {
        "trending_score": trending,
        "stream_reviews_period": marts.mart_review_analysis(games, r, **at),
        "total_starts_period": marts.mart_session_analysis(games, s, **at),
        "total_purchases_24h": marts.mart_price_analysis(games, p, hours=48, **at),
    }
    for name, mart in of.items():
        assert "BroadcastHashJoin" not in plan_of(mart), name
    assert {name: rows(mart.select(name)) for name, mart in of.items()} == {
        "trending_score": [(27,)], "stream_reviews_period": [(2,)], "total_starts_period": [(4,)], "total_purchases_24h": [(3,)]}


def test_catalogues_are_read_once_where_one_record_counts(spark):
    b, a = files(spark, B_DDL, [b_row(1, "Doom")]), files(spark, A_DDL, [a_row(10, "doom")])
    plan = marts.mart_games(b, a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def broadcast_joins(df):
    """Joins that go through the driver, but for those of the slices' borders."""
    return [line for line in plan_of(df).splitlines() if "BroadcastHashJoin" in line and "_slice" not in line]


def test_findings_that_are_read_later_were_joined_by_sorting(spark):
    """q_graph_anomalies reads the stored findings, which the session's first reader builds."""
    assert broadcast_joins(entry._findings(spark, SMALL)) == []
    found = entry.queries()["q_graph_anomalies"](spark, SMALL).collect()
    assert all((f.anomaly_type, f.severity) == ("isolated_game", "High") for f in found)


def test_severities_of_findings_are_counted_without_broadcasts(spark):
    """severity_kpis over findings that are not stored: one row, and no join of games through the driver."""
    counted = dashboard.severity_kpis(entry._findings(spark, SMALL))
    assert broadcast_joins(counted) == [] and "SortMergeJoin" in plan_of(counted)
    assert counted.count() == 1
