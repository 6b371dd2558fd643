"""Games mart, rankings, graph edges and detectors, data checks, request roll-ups, live state."""

from datetime import datetime, timedelta

import pytest
from helpers import frame, plan_of, rows
from ludoscope.operators import live, ordered, quality, ranking, requests
from ludoscope.plans import anomalies, dashboard, graph, marts, reports
from pyspark.sql import Window
from pyspark.sql import functions as F

A_DDL = ("game_id int, game_name string, summary string, rating double, rating_normalized double, rating_count int, "
         "release_date date, genres string, primary_genre string, themes string, platforms string, keywords string, "
         "game_modes string, developer string, publisher string")
B_DDL = ("steam_app_id int, game_name string, developer string, publisher string, owners_range string, owners_estimate bigint, "
         "concurrent_users int, price_usd double, initial_price_usd double, discount_pct int, positive_reviews int, "
         "negative_reviews int, review_score double, avg_playtime_hours double, avg_playtime_2weeks_hours double, "
         "median_playtime_hours double, price_tier string, review_label string, tags string, languages string, steam_genre string")


def a_row(i, name, count=1, developer="", publisher="", genre=""):
    return (i, name, None, None, None, count, None, genre, genre, None, None, None, None, developer, publisher)


def b_row(i, name, owners=0, ccu=0, score=None, genre="G"):
    return (i, name, "bd", "bp", None, owners, ccu, 1.0, 1.0, 0, 1, 1, score, 1.0, 1.0, 1.0, "cheap", "mixed", None, None, genre)


def build(spark, b, a, **options):
    return marts.mart_games(frame(spark, B_DDL, b), frame(spark, A_DDL, a), **options)


def test_games_join_fans_out_or_dedupes(spark):
    b = [b_row(1, "Doom"), b_row(2, " quake "), b_row(3, None), b_row(4, "")]
    a = [a_row(10, " DOOM", 1, "ad", "", "x"), a_row(11, "doom", 9, "", "ap"), a_row(12, None), a_row(13, " ")]
    got = rows(build(spark, b, a, dedupe=False).select("steam_app_id", "igdb_id", "developer", "publisher", "primary_genre_final"))
    assert got == [(1, 10, "ad", "bp", "x"), (1, 11, "bd", "ap", "G"), (2, None, "bd", "bp", "G"),
                   (3, None, "bd", "bp", "G"), (4, None, "bd", "bp", "G")]
    assert rows(build(spark, b, a).select("steam_app_id", "igdb_id"), "steam_app_id") == [
        (1, 11), (2, None), (3, None), (4, None)]


def test_blank_titles_do_not_meet(spark):
    b, a = [b_row(k, " ") for k in range(50)], [a_row(k, "") for k in range(40)]
    assert build(spark, b, a, dedupe=False).count() == 50


def test_prices_read_their_inputs_once(spark):
    catalogue = frame(spark, "steam_app_id int, price_tier string, price_usd double, owners_estimate bigint, review_score double, popularity_score double", [])
    sold = frame(spark, "window_start timestamp, steam_app_id int, num_purchases bigint, revenue_net_usd double", [])
    plan = marts.mart_price_analysis(catalogue, sold, as_of="2024-01-02")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_popularity_score_and_tier(spark):
    b = [b_row(1, "a", 0, 0, None), b_row(2, "b", None, None, 50.0), b_row(3, "c", 1, 1, 66.7), b_row(4, "d", 10**8, 10**4, 90.0)]
    got = rows(build(spark, b, []).select("steam_app_id", "popularity_score", "popularity_tier"), "steam_app_id")
    assert got == [(1, 0.0, "unknown"), (2, 15.0, "niche"), (3, 20.01, "niche"), (4, 137.52, "superstar")]


def test_genre_stats_ranks_and_shares(spark):
    b = [b_row(1, "a", 10, 0, 50.0, "X"), b_row(2, "b", 10, 0, None, "Y"), b_row(3, "c", 0, 0, 60.0, "X"), b_row(4, "d", 1, 0, 1.0, "")]
    got = rows(marts.mart_genre_stats(build(spark, b, [])).select(
        "genre", "num_games", "market_share_pct", "avg_review_score", "positive_rate_pct", "rank_by_owners", "rank_by_games"), "genre")
    assert got == [("X", 2, 66.67, 55.0, 50.0, 1, 1), ("Y", 1, 33.33, None, 50.0, 2, 2)]


def test_sliced_row_number_equals_plain_window(spark):
    # A third of the rows share one value, and some have none.
    df = spark.range(5000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900))).alias("value"))
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc_nulls_last(), "key")))
    sliced = ranking.row_numbers(df, "key", {"rank": "value"})
    assert rows(sliced.select("key", "rank"), "rank") == rows(plain.select("key", "rank"), "rank")


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_sliced_row_number_within_groups(spark, monkeypatch, slices):
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("grp"),
        F.col("id").alias("key"), (F.col("id") % 50).alias("value"))
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("value").desc(), "key")))
    shape = ordered.sliced
    monkeypatch.setattr(ranking, "sliced", lambda df, by, order: shape(df, by, order, slices))
    sliced = ranking.sliced_row_number(df, "value", "key", "rank", by="grp")
    assert rows(sliced.select("key", "rank")) == rows(plain.select("key", "rank"))


def test_no_window_over_the_whole_table(spark):
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 7).alias("value"))
    plan = plan_of(ranking.row_numbers(df, "key", {"rank": "value"}))
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_slice" in line for line in windows)


GAME_DDL = "steam_app_id int, genre string, popularity_score double"


def test_similar_edges_pool_ties_and_gap(spark):
    data = [(i, "big", 100.0 - i) for i in range(25)]
    pooled = rows(graph.edges_similar(frame(spark, GAME_DDL, data), pool=20))
    assert max(e[1] for e in pooled) == 19 and set(pooled) <= set(rows(graph.edges_similar(frame(spark, GAME_DDL, data))))


def test_similar_edges_ties_and_gap(spark):
    data = [(i, "big", 100.0 - i) for i in range(25)]
    data += [(101, "tie", 50.0), (102, "tie", 50.0), (103, "tie", 0.0), (104, "tie", None)]
    data += [(201, "gap", 100.0), (202, "gap", 70.0), (203, "gap", 49.01), (301, "", 5.0), (302, None, 5.0)]
    edges = graph.edges_similar(frame(spark, GAME_DDL, data))
    got = rows(edges)
    big = [e for e in got if e[3] == "big"]
    assert max(e[1] for e in big) == 24 and (0, 5, 0.95, "big") in big and (0, 6, 0.94, "big") not in big
    assert [e for e in got if e[3] == "tie"] == [(101, 102, 1.0, "tie")]
    assert [e for e in got if e[3] == "gap"] == [(202, 203, 0.7, "gap")]
    want = brute_force(data)
    assert sorted(got) == sorted(want)


def brute_force(data):
    by_genre = {}
    for app, genre, score in data:
        if genre and score:
            by_genre.setdefault(genre, []).append((-score, app))
    found = []
    for genre, items in by_genre.items():
        best = sorted(items)
        for i, (sa, a) in enumerate(best):
            for sb, b in best[i + 1 : i + 6]:
                high, low = round(-sa * 100), round(-sb * 100)
                if 10 * (high - low) < 3 * high:
                    found.append((a, b, (2000 * low + high) // (2 * high) / 1000, genre))
    return found


def test_one_edge_per_pair_across_genres(spark):
    data = [(1, "x", 10.0), (2, "x", 9.0), (1, "y", 10.0), (2, "y", 9.0)]
    assert rows(graph.edges_similar(frame(spark, GAME_DDL, data))) == [(1, 2, 0.9, "y")]


def test_named_edges_equal_the_single_kinds(spark):
    games = frame(spark, "steam_app_id int, genre string, developer string, publisher string, platforms string, themes string, tags string",
                  [(1, "g", "A, B", "X, Inc.", "pc", None, "a,b,c,d"), (1, "g", "A", "X", "pc, mac", "t", "a"), (2, None, "", None, " ,", "t", None)])
    every = graph.named_edges(games)
    single = graph.edges_genre(games)
    for kind in ("developer", "publisher", "platform", "theme", "tag"):
        single = single.unionByName(getattr(graph, f"edges_{kind}")(games))
    assert rows(every) == rows(single)
    assert ("X", "PUBLISHED_BY") in [r[1:] for r in rows(every)] and ("d", "TAGGED_WITH") in [r[1:] for r in rows(every)]


NODE_DDL = "steam_app_id int, name string, owners_estimate bigint, popularity_score double, popularity_tier string"


def test_isolated_games(spark):
    nodes = frame(spark, NODE_DDL, [
        (1, "from", 200_000, 70.0, "hit"), (2, "to", 200_000, 70.0, "hit"), (3, "few", 100_000, 70.0, "hit"),
        (4, "more", 100_001, 30.1, "mid"), (5, "low", 200_000, 30.0, "mid"), (6, "top", 1_234_567, 60.5, "hit")])
    similar = frame(spark, "a int, b int", [(1, 2)])
    got = rows(anomalies.isolated_games(nodes, similar).select("entity_name", "description", "severity"))
    assert got == [
        ("more", "more has no similar games (score:30.1, tier:mid, owners:100,001)", "Medium"),
        ("top", "top has no similar games (score:60.5, tier:hit, owners:1,234,567)", "High")]


def test_sales_inconsistency(spark):
    nodes = frame(spark, NODE_DDL, [(1, "a", 1, 30.0, "x"), (2, "b", 1, 10.0, "x"), (3, "c", 1, 93.0, "x"), (4, "d", 1, 153.0, "x"), (5, "e", 1, 0.0, "x")])
    edges = frame(spark, "a int, b int, similarity_score double, genre string",
                  [(1, 2, 0.9, "g"), (1, 3, 0.8, "g"), (1, 4, 0.7, "g"), (5, 4, 0.7, "g")])
    got = rows(anomalies.sales_inconsistency(edges, nodes).select("related_entity", "metric_value", "severity", "description"))
    assert got == [("c", 3.1, "Medium", "a (score:30.0) vs c (score:93.0) - 3.1x diff despite similarity=0.8 (g)"),
                   ("d", 5.1, "High", "a (score:30.0) vs d (score:153.0) - 5.1x diff despite similarity=0.7 (g)")]


def test_publisher_dominance(spark):
    def edges(pairs):
        return frame(spark, "src_id int, dst string", pairs)

    genre = edges([(i, "g4") for i in range(4)] + [(i, "g6") for i in range(10, 16)] + [(i, "g3") for i in range(20, 23)])
    publisher = edges([(0, "P"), (1, "P"), (2, "P"), (3, "Q")] + [(i, "H") for i in range(10, 13)] + [(i, "I") for i in range(13, 16)]
                      + [(20, "T"), (21, "T")])
    got = rows(anomalies.publisher_dominance(publisher, genre))
    assert got == [("publisher_dominance", "P", "Publisher", "g4", "P controls 75.0% of g4 (3/4 games)", 75.0, "High")]


def test_similar_games_reads_both_directions(spark):
    nodes = frame(spark, NODE_DDL, [(i, f"g{i}", 1, 1.0, "x") for i in range(1, 5)])
    similar = frame(spark, "a int, b int, similarity_score double, genre string",
                    [(1, 2, 0.8, "g"), (3, 1, 0.9, "g"), (2, 3, 1.0, "g"), (1, 1, 1.0, "g")])
    got = graph.similar_games(similar, nodes, 1, 2).collect()
    assert [(r.steam_app_id, r.similarity) for r in got] == [(1, 1.0), (3, 0.9)]


def test_nodes_keep_unlinked_statistics_and_unlisted_names(spark):
    stats = frame(spark, "publisher string, market_share_pct double, rank int, num_games bigint, total_owners bigint, avg_review_score double, num_distinct_genres bigint",
                  [("P", 1.0, 1, 2, 3, None, 1), ("", 1.0, 2, 2, 3, 1.0, 1)])
    edges = frame(spark, "src_id int, dst string", [(1, "Q"), (2, "Q")])
    got = rows(graph.nodes_publisher(stats, edges).select("name", "num_games", "avg_review_score"))
    assert got == [("P", 2, 0.0), ("Q", None, None)]


def test_quality_checks(spark):
    df = frame(spark, "k int, tier string", [(1, "mid"), (1, "odd"), (None, None), (None, "hit")])
    assert quality.not_null(df, "k").count() == 2
    assert rows(quality.unique(df, "k")) == [(1, 2)]
    assert rows(quality.accepted_values(df, "tier", quality.POPULARITY_TIERS)) == [(1, "odd")]
    report = quality.check_not_null({"t": df}, {"t": "k"})
    assert rows(report) == [("not_null", "t", "k", 2)]


def test_request_quantiles_and_errors(spark):
    t = datetime(2024, 1, 1)
    log = frame(spark, "ts timestamp, handler string, status int, duration_s double",
                [(t + timedelta(seconds=i), "h", 503 if i < 2 else 404, 0.004 if i < 5 else 0.2) for i in range(10)]
                + [(t + timedelta(minutes=6), "h", 200, 99.0)])
    assert rows(requests.error_rate(log), "window_start") == [(t, 10, 0.2, 2 / 300), (t + timedelta(minutes=5), 1, 0.0, 0.0)]
    got = rows(requests.latency_quantiles(log), "window_start")
    assert got[0][1:3] == (10, 0.005) and abs(got[0][3] - (0.1 + 0.15 * 4.5 / 5)) < 1e-12 and 60.0 < got[1][2] <= 120.0
    exact = log.groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.expr("percentile_disc(0.95) within group (order by duration_s)").alias("p95"))
    sliced = rows(requests.latency_percentiles(log).select("window_start", "p95"), "window_start")
    assert [r[1] for r in sliced] == [r.p95 for r in exact.orderBy("w").collect()]
    assert rows(requests.request_rate(log, "status").filter("status = 503")) == [(t, 503, 2 / 60)]


def test_rates_follow_the_window_and_long_answers_do_not_saturate(spark):
    t = datetime(2024, 1, 1)
    log = frame(spark, "ts timestamp, handler string, status int, duration_s double", [(t + timedelta(seconds=i), "h", 500, 42.0) for i in range(600)])
    assert rows(requests.request_rate(log, window="10 minutes")) == [(t, 1.0)]
    assert rows(requests.error_rate(log, window="10 minutes").select("errors_per_sec")) == [(1.0,)]
    p50 = requests.latency_quantiles(log, window="10 minutes").first().p50
    assert 30.0 < p50 <= 60.0
    late = log.withColumn("duration_s", F.lit(6_000.0))
    assert 600.0 < requests.latency_quantiles(late, window="10 minutes").first().p99 <= 6_000.0


def test_percentiles_of_a_large_group_are_exact(spark):
    log = spark.range(60_000).select(
        F.lit(datetime(2024, 1, 1)).cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("handler"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(50_021)) / 100_000).alias("duration_s"))
    got = rows(requests.latency_percentiles(log, "handler", quantiles=(0.5, 0.999)), "handler")
    want = log.groupBy("handler").agg(F.count("duration_s"), *[
        F.expr(f"percentile_disc({q}) within group (order by duration_s)") for q in (0.5, 0.999)]).orderBy("handler").collect()
    assert [tuple(r[1:]) for r in got] == [tuple(r) for r in want]


def live_rows(spark, data):
    return frame(spark, "window_start timestamp, game_id int, num_purchases bigint, revenue_net_usd double, updated_at timestamp", data)


def test_live_state_newest_window_and_expiry(spark):
    now = datetime(2024, 1, 1, 12)
    data = [
        (now - timedelta(seconds=60), 1, 1, 1.0, now - timedelta(seconds=20)),
        (now - timedelta(seconds=30), 1, 2, None, now - timedelta(seconds=25)),
        (now - timedelta(seconds=700), 2, 9, 9.0, now - timedelta(seconds=600)),
        (now - timedelta(seconds=700), 3, 9, 9.0, now - timedelta(seconds=599)),
        (now, None, 1, 1.0, now),
    ]
    state = live.live_state({"purchases": live_rows(spark, data)}, as_of=now)
    assert rows(state.select("game_id", "num_purchases", "revenue_net_usd")) == [(1, 2, None), (3, 9, 9.0)]
    hashes = {r.key: r.data for r in live.as_hash(state).collect()}
    assert set(hashes) == {"stat:purchases:1", "stat:purchases:3"}
    assert "revenue_net_usd" not in hashes["stat:purchases:1"] and hashes["stat:purchases:1"]["num_purchases"] == "2"
    assert live.live_stat(state, "purchases", 3).count() == 1 and live.live_all(state, limit=1).count() == 1


def test_live_totals_treat_bad_text_as_zero(spark):
    ddl = "topic string, game_id int, num_purchases string, revenue_net_usd string, num_reviews string, num_starts string, num_ends string, net_added string"
    state = frame(spark, ddl, [("purchases", 1, "2", "1.5", None, None, None, None), ("purchases", 2, "x", "nope", None, None, None, None),
                               ("sessions", 1, None, None, None, "3", "4", None), ("wishlist", 1, None, None, None, None, None, "-2")])
    assert rows(dashboard.live_kpis(state)) == [(1.5, 2, 0, 7, -2)]
    assert rows(dashboard.live_pulse(state)) == [("Purchases", 2), ("Reviews", 0), ("Sessions", 7), ("Wishlist", -2)]
    assert rows(dashboard.live_top(state, 1)) == [("purchases", 1, 1.5), ("sessions", 1, 7.0), ("wishlist", 1, -2.0)]


def test_game_list_filters(spark):
    b = [b_row(1, "a", 10, 0, 50.0, "Action RPG"), b_row(2, "b", 20, 0, 50.0, "rpg"), b_row(3, "c", 30, 0, 50.0, "Indie")]
    games = build(spark, b, [])
    assert [r[0] for r in reports.list_games(games, genre="RPG").collect()] == [2, 1]
    assert [r[0] for r in reports.list_games(games, min_owners=20, limit=1).collect()] == [3]


def test_plans_stay_in_the_jvm_and_limit_before_shuffle(spark):
    games = frame(spark, GAME_DDL, [(1, "x", 1.0)])
    plan = plan_of(graph.edges_similar(games))
    assert "Python" not in plan
    assert all("_slice" in line for line in plan.split("\n") if "Window [" in line)
