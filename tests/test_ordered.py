"""Sums, last values, neighbours and tiles over slices, against plain windows; as-of joins and overlapping ranges."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import frame, plan_of, rows
from ludoscope.operators import as_of, ordered, overlaps
from ludoscope.operators.ordered import SLICE
from pyspark.sql import Window
from pyspark.sql import functions as F

T = datetime(2024, 1, 1)
BY, ORDER = ["grp"], ["at", "key"]


def data(spark, n=1500, gaps=3):
    """A group with half of the rows, small ones, and a NULL one; equal times, NULL times and NULL values."""
    key = F.col("id")
    return spark.range(n).select(
        F.when(key % 2 == 0, "hot").when(key % 23 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), key % 40)).alias("grp"),
        F.when(key % 31 != 5, F.pmod(F.xxhash64(key), F.lit(200))).alias("at"),
        key.alias("key"),
        F.when(key % gaps == 0, key * 10).alias("value"),
        F.pmod(F.xxhash64(key, F.lit(1)), F.lit(9)).alias("amount"),
    )


def plainly(df, **columns):
    return rows(df.withColumns(columns).select("key", *columns))


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_sums_and_numbers(spark, slices):
    df = data(spark)
    cut = ordered.sliced(df, BY, ORDER, slices)
    window = Window.partitionBy("grp").orderBy("at", "key")
    upto, onward = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(0, Window.unboundedFollowing)
    got = ordered.running_sum(cut, BY, ORDER, {"a": "amount", "b": "key"})
    assert rows(got.select("key", "a", "b")) == plainly(df, a=F.sum("amount").over(upto), b=F.sum("key").over(upto))
    got = ordered.running_sum(cut, BY, ORDER, {"a": "amount"}, backwards=True)
    assert rows(got.select("key", "a")) == plainly(df, a=F.sum("amount").over(onward))
    for tiles in (1, 4, 10, 1000):
        got = ordered.ntile(cut, BY, ORDER, tiles, "tile")
        assert rows(got.select("key", "tile")) == plainly(df, tile=F.ntile(tiles).over(window))
        assert got.columns == [*df.columns, SLICE, "tile"]


@pytest.mark.parametrize("slices, gaps", [(1, 3), (7, 3), (64, 3), (64, 400), (13, 5000)])
def test_last_known_values(spark, slices, gaps):
    df = data(spark, gaps=gaps)
    cut = ordered.sliced(df, BY, ORDER, slices)
    window = Window.partitionBy("grp").orderBy("at", "key").rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.last_known(cut, BY, ORDER, {"known": "value"})
    assert rows(got.select("key", "known")) == plainly(df, known=F.last("value", ignorenulls=True).over(window))


@pytest.mark.parametrize("slices", [1, 5, 64, 900])
def test_neighbours(spark, slices):
    """With 900 slices most hold a row or two, so neighbours lie several slices away."""
    df = data(spark, 900)
    cut = ordered.sliced(df, BY, ORDER, slices)
    window = Window.partitionBy("grp").orderBy("at", "key")
    got = ordered.previous(ordered.following(cut, BY, ORDER, "value", "after"), BY, ORDER, "value", "before")
    assert rows(got.select("key", "after", "before")) == plainly(df, after=F.lead("value").over(window), before=F.lag("value").over(window))
    got = ordered.neighbours(cut, BY, ORDER, F.col("key"), "next", count=5)
    assert rows(got.select("key", "next")) == plainly(df, next=F.collect_list("key").over(window.rowsBetween(1, 5)))


def test_without_groups_and_without_rows(spark):
    df = data(spark, 200)
    window = Window.orderBy("at", "key")
    got = ordered.previous(ordered.sliced(df, [], ORDER, 9), [], ORDER, "key", "before")
    assert rows(got.select("key", "before")) == plainly(df, before=F.lag("key").over(window))
    got = ordered.row_number(ordered.sliced(df, [], ORDER, 9), [], ORDER, "n")
    assert rows(got.select("key", "n")) == plainly(df, n=F.row_number().over(window).cast("bigint"))
    none = ordered.sliced(df.filter("key < 0"), BY, ORDER, 9)
    assert ordered.ntile(ordered.previous(none, BY, ORDER, "key", "b"), BY, ORDER, 3, "t").count() == 0


def test_no_task_holds_a_group(spark):
    cut = ordered.sliced(data(spark, 20_000), BY, ORDER, 40)
    sizes = [r[0] for r in cut.groupBy(SLICE).count().select("count").collect()]
    assert len(sizes) >= 35 and max(sizes) < 20_000 / 40 * 4
    for df in (ordered.ntile(cut, BY, ORDER, 10, "tile"), ordered.previous(cut, BY, ORDER, "key", "p"), ordered.last_known(cut, BY, ORDER, {"k": "value"})):
        windows = [line for line in plan_of(df).split("\n") if "Window [" in line]
        assert windows and all(SLICE in line for line in windows)


PRICES = "game int, since timestamp, price double, version int"
EVENTS = "id int, game int, at timestamp, price string"


def plain_in_force(events, prices):
    out = []
    for i, game, at in events:
        found = [(s, v or -1, p) for g, s, p, v in prices if g is not None and g == game and s is not None and at is not None and s <= at]
        out.append((i, max(found)[2] if found else None))
    return sorted(out)


@pytest.mark.parametrize("slices", [None, 1, 9, 200])
def test_price_in_force(spark, slices):
    rng = random.Random(3)
    prices = [(rng.choice([1, 1, 1, 2, 3, None]), T + timedelta(hours=rng.randrange(300)), float(k), k) for k in range(120)]
    prices += [(2, None, 1.0, 1), (4, T + timedelta(hours=400), 9.0, None)]
    events = [(k, rng.choice([1, 1, 1, 2, 3, 4, 5, None]), T + timedelta(hours=rng.randrange(-5, 310)) if k % 50 else None) for k in range(600)]
    left = frame(spark, "id int, game int, at timestamp", events)
    right = frame(spark, PRICES, prices)
    got = as_of.in_force(left, right, ["game"], "at", ["price"], state_time="since", version="version", slices=slices)
    assert sorted(rows(got.select("id", "price"))) == plain_in_force(events, prices)


def test_price_in_force_at_ties_and_of_nothing(spark):
    right = frame(spark, PRICES, [(1, T, 5.0, 1), (1, T, 6.0, 2), (1, T + timedelta(days=2), None, 3)])
    left = frame(spark, "id int, game int, at timestamp", [(1, 1, T), (1, 1, T), (2, 1, T - timedelta(seconds=1)), (3, 1, T + timedelta(days=2))])
    got = as_of.in_force(left, right, ["game"], "at", ["price", "version"], state_time="since", version="version")
    assert rows(got.select("id", "price", "version")) == [(1, 6.0, 2), (1, 6.0, 2), (2, None, None), (3, None, 3)]
    assert as_of.in_force(left.limit(0), right, ["game"], "at", ["price"], state_time="since").count() == 0
    alone = as_of.in_force(left, right.limit(0), ["game"], "at", ["price"], state_time="since")
    assert rows(alone.select("id", "price")) == [(1, None), (1, None), (2, None), (3, None)]


def test_a_hot_game_is_spread(spark):
    """All events are of one game; its only price lies in the first slice."""
    left = spark.range(5000).select(F.col("id"), F.lit(1).alias("game"), F.timestamp_seconds(F.col("id")).alias("at"))
    right = frame(spark, PRICES, [(1, datetime(1960, 1, 1), 7.0, 1)])
    got = as_of.in_force(left, right, ["game"], "at", ["price"], state_time="since", slices=20)
    assert got.filter("price = 7.0").count() == 5000
    assert "CartesianProduct" not in plan_of(got) and "NestedLoop" not in plan_of(got)


def ranges(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = T + timedelta(seconds=rng.randrange(86_400 * 5))
        out.append((k, rng.choice([1, 1, 1, 2, None]), start, start + timedelta(seconds=rng.choice([0, 30, 3600, 3601, 40_000, longest]))))
    return out


def test_overlapping_ranges(spark):
    """Ranges of seconds, of hours and of ten years meet each other, every pair once."""
    ddl = "id int, game int, start timestamp, stop timestamp"
    year = 86_400 * 365
    a = [*ranges(1, 150, 10 * year), (900, 1, None, T), (901, 1, T, None), (902, 1, T + timedelta(1), T)]
    b = [*ranges(2, 150, year), (950, 1, T - timedelta(10), T + timedelta(10)), (950, 1, T - timedelta(10), T + timedelta(10))]
    got = overlaps.overlapping(frame(spark, ddl, a), frame(spark, ddl, b), ["game"], ("start", "stop"), ("start", "stop"))
    want = [(x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and None not in (*x[2:], *y[2:])
            and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(tuple(r) for r in got.select("left.id", "right.id").collect()) == sorted(want)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_a_long_range_is_listed_a_few_times(spark):
    ddl = "id int, game int, start timestamp, stop timestamp"
    long = overlaps._ranges(frame(spark, ddl, [(1, 1, T, T + timedelta(days=3650))]), ["game"], "start", "stop", "left")
    assert overlaps._in_cells(long, [0, 1, 2], "l").count() <= 2
    short = overlaps._ranges(frame(spark, ddl, [(1, 1, T, T + timedelta(seconds=5))]), ["game"], "start", "stop", "left")
    assert overlaps._in_cells(short, [0, 3, 6], "l").count() <= 6


def test_events_in_campaigns(spark):
    events = frame(spark, "id int, game int, at timestamp", [(1, 1, T), (2, 1, T + timedelta(hours=1)), (3, 2, T), (4, 1, None), (5, 1, T - timedelta(microseconds=1))])
    campaigns = frame(spark, "name string, game int, start timestamp, stop timestamp", [("a", 1, T, T + timedelta(hours=1)), ("b", 1, T - timedelta(days=400), T + timedelta(days=400))])
    got = overlaps.at_moments(events, campaigns, ["game"], "at", ("start", "stop"))
    assert rows(got.select("left.id", "right.name")) == [(1, "a"), (1, "b"), (2, "b"), (5, "b")]
    assert got.select("left.*").columns == events.columns
