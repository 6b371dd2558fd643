"""Event windows, their flags, and the marts over them."""

from datetime import datetime

from helpers import frame, rows
from ludoscope.operators import staging, windows
from ludoscope.plans import marts, reports
from ludoscope.sources import topics
from pyspark.sql import functions as F

T = datetime(2024, 1, 1, 12, 0, 0)


def at(second, micro=0, minute=0):
    return T.replace(second=second, microsecond=micro, minute=minute)


def purchases(spark, data):
    return frame(spark, "event_time timestamp, game_id int, price_usd double, discount_pct int", data)


def test_window_edges_and_null_discount(spark):
    df = purchases(spark, [
        (at(0), 1, 10.0, 0), (at(29, 999_999), 1, 10.0, 25), (at(30), 1, 9.99, 50), (at(31), 1, 5.0, None),
        (None, 1, 1.0, 0), (at(1), 2, 3.0, None),
    ])
    got = rows(windows.aggregate_windows(df, "purchases"), "window_start", "game_id")
    assert got == [(at(0), 1, 2, 17.5), (at(0), 2, 1, None), (at(30), 1, 2, 4.995)]


def test_session_and_review_and_wishlist_measures(spark):
    sessions = frame(spark, "event_time timestamp, game_id int, event_type string, duration_seconds int", [
        (at(0), 1, "session_start", None), (at(1), 1, "session_end", 100), (at(2), 1, "session_end", 50),
        (at(3), 1, "session_heartbeat", 7)])
    assert rows(windows.aggregate_windows(sessions, "sessions")) == [(at(0), 1, 1, 2, 75.0)]
    reviews = frame(spark, "event_time timestamp, game_id int, rating int, recommended boolean",
                    [(at(0), 1, 7, True), (at(1), 1, 2, False), (at(2), 1, 3, None)])
    assert rows(windows.aggregate_windows(reviews, "reviews")) == [(at(0), 1, 3, 4.0, 100.0 / 3)]
    wishlist = frame(spark, "event_time timestamp, game_id int, action string",
                     [(at(0), 1, "added"), (at(1), 1, "removed"), (at(2), 1, "removed")])
    assert rows(windows.aggregate_windows(wishlist, "wishlist")) == [(at(0), 1, 1, 2, -1)]


def test_malformed_message_is_a_null_row(spark):
    raw = frame(spark, "value string", [("{bad",), ('{"event_id": "1", "game_id": 5}',)])
    parsed = topics.parse_messages(raw, "wishlist")
    good, bad = topics.split_malformed(parsed)
    assert (good.count(), bad.count()) == (1, 1)


def test_flags_at_their_limits(spark):
    p = frame(spark, "window_start timestamp, game_id int, num_purchases bigint, revenue_net_usd double",
              [(T, 1, 14, 14.0), (T, 2, 15, 1.0), (T, None, 99, 1.0), (T, 3, 0, 0.0)])
    got = rows(staging.stage_purchase_windows(p).select(
        "steam_app_id", "window_end", "avg_price_per_purchase", "is_viral"), "steam_app_id")
    assert got == [(1, at(30), 1.0, False), (2, at(30), 0.07, True), (3, at(30), None, False)]
    r = frame(spark, "window_start timestamp, game_id int, num_reviews bigint, avg_rating double, recommend_pct double",
              [(T, 1, 10, 3.9, 50.0), (T, 2, 10, 4.0, 50.0), (T, 3, 5, 9.0, 29.9), (T, 4, 4, 0.0, 0.0), (T, 5, 10, None, None)])
    assert [x[0] for x in rows(staging.stage_review_windows(r).orderBy("steam_app_id").select("is_review_bomb"), "steam_app_id")] == [
        True, False, True, False, False]
    s = frame(spark, "window_start timestamp, game_id int, num_starts bigint, num_ends bigint, avg_duration_sec double",
              [(T, 1, 19, 0, None), (T, 2, 20, 1, 90.0)])
    assert rows(staging.stage_session_windows(s).select("avg_duration_min", "is_ccu_spike")) == [(1.5, True), (None, False)]
    w = frame(spark, "window_start timestamp, game_id int, num_added bigint, num_removed bigint, net_added bigint",
              [(T, 1, 14, 0, 14), (T, 2, 15, 0, 15)])
    assert rows(staging.stage_wishlist_windows(w).select("steam_app_id", "is_viral_wishlist")) == [(1, False), (2, True)]


def test_staged_purchase_rounds_half_cents_up(spark):
    df = frame(spark, "event_id string, event_time timestamp, game_id int, price_usd double, discount_pct int",
               [("a", at(59, 0, 7), 1, 9.99, 50), ("b", T, 1, 1.10, 25), (None, T, 1, 1.0, 0), ("c", T, None, 1.0, 0),
                ("d", T, 1, 1.0, None)])
    got = rows(staging.stage_purchases(df).select("event_id", "revenue_net_usd", "event_hour", "event_day"), "event_id")
    day = datetime(2024, 1, 1)
    assert got == [("a", 5.0, T, day), ("b", 0.83, T, day), ("d", None, T, day)]


def test_session_staging_keeps_rows_without_game(spark):
    df = frame(spark, "event_id string, event_time timestamp, game_id int, duration_seconds int",
               [("a", T, None, 5400), (None, T, 1, 1)])
    assert rows(staging.stage_sessions(df).select("event_id", "duration_hours")) == [("a", 1.5)]


def games(spark, data):
    return frame(spark, "steam_app_id int, game_name string, developer string, publisher string, primary_genre_final string, "
                 "owners_estimate bigint, popularity_score double, popularity_tier string, review_score double", data)


def staged(spark, purchases=(), reviews=(), sessions=(), wishlist=()):
    return (
        frame(spark, "window_start timestamp, steam_app_id int, num_purchases bigint, revenue_net_usd double, is_viral boolean", list(purchases)),
        frame(spark, "window_start timestamp, steam_app_id int, num_reviews bigint, avg_rating double, recommend_pct double, is_review_bomb boolean", list(reviews)),
        frame(spark, "window_start timestamp, steam_app_id int, num_starts bigint, num_ends bigint, avg_duration_sec double, is_ccu_spike boolean", list(sessions)),
        frame(spark, "window_start timestamp, steam_app_id int, net_added bigint, is_viral_wishlist boolean", list(wishlist)),
    )


def test_trending_keeps_shrinking_wishlists_and_drops_idle_games(spark):
    catalogue = games(spark, [(i, f"g{i}", "d", "p", "x", 1, 1.0, "mid", 50.0) for i in range(1, 6)])
    old = datetime(2023, 11, 1)
    activity = marts.recent_activity(
        *staged(
            spark,
            purchases=[(T, 1, 2, 10.5, False), (T, 1, 3, None, True), (old, 4, 9, 9.0, True), (T, 99, 1, 1.0, False)],
            reviews=[(T, 1, 1, 4.0, 100.0, False), (T, 1, 3, 8.0, 0.0, False)],
            sessions=[(T, 2, 4, 1, 60.0, False), (T, 3, 0, 0, None, False)],
            wishlist=[(T, 5, -3, False), (T, 3, 0, False)],
        ),
        as_of="2024-01-10 00:00:00",
    )
    got = marts.mart_trending(catalogue, activity).select(
        "steam_app_id", "trending_score", "total_revenue_period_usd", "avg_rating_period", "had_viral_purchases_period", "lookback_days")
    assert [tuple(r) for r in got.collect()] == [
        (1, 37, 10.5, 6.0, True, 30), (2, 4, 0.0, None, False, 30), (5, -6, 0.0, None, False, 30)]
    weighted = marts.recent_activity(*staged(spark, reviews=[(T, 1, 1, 4.0, 100.0, False), (T, 1, 3, 8.0, 0.0, False)]),
                                     as_of="2024-01-10 00:00:00", weighted=True)
    assert weighted.select("avg_rating_period").first()[0] == 7.0


def test_price_lookback_counts_hours(spark):
    catalogue = frame(spark, "steam_app_id int, price_tier string, price_usd double, owners_estimate bigint, review_score double, popularity_score double",
                      [(1, "free", 0.0, 3, None, 10.0), (2, "aaa", 70.0, 1, 50.0, 20.0), (3, "aaa", 61.0, 0, 51.0, 20.0)])
    p = staged(spark, purchases=[(datetime(2024, 1, 1), 2, 2, 3.005, False), (datetime(2023, 12, 31, 23), 2, 5, 5.0, False)])[0]
    got = rows(marts.mart_price_analysis(catalogue, p, as_of="2024-01-02 00:00:00"), "price_tier")
    assert got == [
        ("aaa", 2, 65.5, 1, 1.0, 25.0, 50.5, 20.0, 2, 3.01, 100.0),
        ("free", 1, 0.0, 3, 3.0, 75.0, None, 10.0, 0, 0.0, 0.0)]


def test_session_report_completion_may_exceed_100(spark):
    catalogue = games(spark, [(1, "g", "d", "p", "x", 1, 1.0, "mid", 50.0)]).withColumns(
        {"concurrent_users": F.lit(1), "avg_playtime_hours": F.lit(1.0)})
    s = staged(spark, sessions=[(T, 1, 2, 3, 90.0, False), (T, 1, 0, 1, 30.0, False)])[2]
    row = marts.mart_session_analysis(catalogue, s, as_of="2024-01-10 00:00:00").first()
    assert (row.completion_rate_pct, row.peak_starts_in_window_period, row.avg_session_duration_min_period) == (200.0, 2, 1.0)


def test_revenue_keeps_small_and_long_prices(spark):
    df = frame(spark, "event_time timestamp, game_id int, price_usd double, discount_pct int",
               [(T, 1, 0.00004, 0), (T, 2, 1.23456789, 50), (T, 3, -2.5, 20), (T, 4, 5.0, None), (T, 5, 9e8, 0)])
    got = rows(windows.aggregate_windows(df, "purchases").select("game_id", "revenue_net_usd"), "game_id")
    assert [r[1] for r in got] == [0.00004, 0.617283945, -2.0, None, 9e8]


def test_latest_version_takes_all_columns_from_one_row(spark):
    versions = frame(spark, "window_start timestamp, game_id int, a int, b int, batch_id int", [(T, 1, 1, 9, 7), (T, 1, 2, 8, 7)])
    assert rows(windows.latest_version(versions)) == [(T, 1, 2, 8)]


def test_latest_version_equals_batch(spark):
    versions = frame(spark, "window_start timestamp, game_id int, num_purchases bigint, revenue_net_usd double, batch_id int",
                     [(T, 1, 1, 1.0, 0), (T, 1, 5, None, 2), (T, 1, 3, 2.0, 1), (T, 2, 1, 1.0, 10)])
    assert rows(windows.latest_version(versions), "game_id") == [(T, 1, 5, None), (T, 2, 1, 1.0)]


def test_unknown_granularity_is_hour(spark):
    w = frame(spark, "window_start timestamp, num_added bigint, num_removed bigint, net_added bigint",
              [(at(0, 0, 10), 1, 0, 1), (at(0, 0, 50), 2, 1, 1)])
    got = rows(reports.wishlist_history(w, "decade", 2, "2024-01-02 00:00:00"))
    assert got == [(T, 3, 1, 2)]
