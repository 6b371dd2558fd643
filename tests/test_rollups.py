"""Sliding windows, sketches, subtotals and differences of loads."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import frame, plan_of, rows
from ludoscope.operators import sketches, sliding, subtotals, windows
from ludoscope.plans.materialise import stored
from ludoscope.sources import tables, topics
from pyspark.sql import functions as F

T = datetime(2024, 1, 1)


def sales(n, seed=1):
    rng = random.Random(seed)
    return [
        (T + timedelta(seconds=rng.randrange(20_000)), rng.choice([1, 1, 1, 2, None]), rng.choice([0.1, 9.99, 2e9, 1e-9, None]), rng.choice([0, 25, None]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("length, slide, slices", [(1800, 30, None), (60, 60, 3), (3600, 600, 17)])
def test_sliding_windows_equal_copies_of_events(spark, length, slide, slices):
    ddl = "event_time timestamp, game_id int, price_usd double, discount_pct int"
    events = frame(spark, ddl, [*sales(300), (None, 1, 1.0, 0)])
    got = sliding.sliding_windows(events, "purchases", length_seconds=length, slide_seconds=slide, slices=slices)
    plain = events.groupBy(F.window("event_time", f"{length} seconds", f"{slide} seconds").alias("w"), "game_id").agg(*windows.measures("purchases"))
    plain = plain.select(F.col("w.start").alias("window_start"), "game_id", "num_purchases", "revenue_net_usd")
    assert rows(got) == rows(plain)


def test_sliding_windows_have_the_tumbling_measures(spark):
    for topic in topics.TOPICS:
        events = topics.parse_messages(frame(spark, "value string", []), topic)
        assert sliding.sliding_windows(events, topic).columns == windows.aggregate_windows(events, topic).columns
    with pytest.raises(ValueError):
        sliding.sliding_windows(events, "reviews", length_seconds=100, slide_seconds=30)


def test_sliding_windows_copy_no_event(spark):
    events = frame(spark, "event_time timestamp, game_id int, price_usd double, discount_pct int", sales(10))
    plan = plan_of(sliding.sliding_windows(events, "purchases"))
    assert "Expand" not in plan
    lines = [line for line in plan.split("\n") if "Window [" in line]
    assert lines and all("_slice" in line for line in lines)


def test_quantiles_of_merged_sketches_keep_the_rank_error(spark):
    rng = random.Random(4)
    log = [(T + timedelta(seconds=k), rng.choice("ab"), rng.lognormvariate(0, 2)) for k in range(40_000)]
    df = frame(spark, "ts timestamp, handler string, duration_s double", [*log, (T, "a", None)])
    minutes = stored(sketches.latency_sketches(df, "handler"), "minutes")
    assert minutes.count() > 1000
    for by in ((), ("handler",)):
        days = sketches.latency_of(sketches.merged_latency(minutes, *by), *by).collect()
        assert sum(r["requests"] for r in days) == 40_000
        for r in days:
            group = sorted(d for _, h, d in log if not by or h == r["handler"])
            for q in sketches.QUANTILES:
                rank = sum(d <= r[f"p{round(q * 100)}"] for d in group) / len(group)
                assert abs(rank - q) <= sketches.RANK_ERROR, (by, q, rank)


def test_merged_distinct_users(spark):
    rng = random.Random(5)
    users = [(T + timedelta(minutes=rng.randrange(14 * 1440)), rng.choice([1, 1, 2]), f"u{rng.randrange(9000)}") for _ in range(30_000)]
    df = frame(spark, "event_time timestamp, game_id int, user_id string", [*users, (T, 1, None)])
    hours = stored(sketches.user_sketches(df, "game_id"), "hours")
    for span, length in (("day", 1), ("week", 7)):
        for r in sketches.users_of(sketches.merged_users(hours, "game_id", span=span), "game_id").collect():
            until = r["window_start"] + timedelta(days=length)
            exact = len({u for t, g, u in users if g == r["game_id"] and r["window_start"] <= t < until})
            assert abs(r["users"] - exact) <= max(2, 4 * sketches.DISTINCT_ERROR * exact)
    total = sketches.users_of(sketches.merged_users(hours, span="year")).first()["users"]
    assert abs(total - len({u for *_, u in users})) <= 4 * sketches.DISTINCT_ERROR * 9000


def test_subtotals_tell_nulls_from_totals(spark):
    df = frame(spark, "kind string, level string, x int", [("a", "High", 1), ("a", None, 2), (None, "High", 4), (None, None, 8), ("b", "Low", None)])
    measures = {"n": F.count(F.lit(1)), "x": F.sum("x")}
    got = rows(subtotals.rolled_up(df, "kind", "level", **measures))
    assert got == sorted([
        ("a", "High", False, False, 0, 1, 1), ("a", None, False, False, 0, 1, 2), (None, "High", False, False, 0, 1, 4), (None, None, False, False, 0, 1, 8),
        ("b", "Low", False, False, 0, 1, None), ("a", None, False, True, 1, 2, 3), (None, None, False, True, 1, 2, 12), ("b", None, False, True, 1, 1, None),
        (None, None, True, True, 3, 5, 15)], key=repr)
    cube = subtotals.all_subtotals(df, "kind", "level", **measures)
    assert rows(cube.filter("all_kind and not all_level").select("level", "n", "x")) == sorted([("High", 2, 5), (None, 2, 10), ("Low", 1, None)], key=repr)
    assert plan_of(cube).count("Exchange") == 1


def test_difference_of_loads(spark):
    ddl = "a int, b string"
    before = frame(spark, ddl, [(1, "x"), (1, "x"), (2, None), (2, None), (3, "y"), (None, None), (5, "same")])
    after = frame(spark, ddl, [(1, "x"), (2, None), (2, None), (2, None), (4, "z"), (None, None), (None, None), (5, "same")])
    got = rows(tables.load_difference(before, after))
    assert got == sorted([(1, "x", 2, 1, "thinned"), (2, None, 2, 3, "repeated"), (3, "y", 1, 0, "removed"), (4, "z", 0, 1, "added"), (None, None, 1, 2, "repeated")], key=repr)
    assert tables.load_difference(before, before).count() == 0
    assert rows(tables.load_difference(before, after, ["b"]).select("b", "n_before", "n_after")) == sorted([("x", 2, 1), (None, 3, 5), ("y", 1, 0), ("z", 0, 1)], key=repr)
