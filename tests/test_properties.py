"""Operators against brute force on random rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from helpers import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from ludoscope.functions import text
from ludoscope.operators import requests
from ludoscope.operators.windows import aggregate_windows
from ludoscope.plans import graph
from pyspark.sql import functions as F
from test_marts_graph import GAME_DDL, brute_force


def test_similar_edges_on_random_genres(spark):
    rng = random.Random(7)
    data = [
        (i, f"g{rng.randrange(12)}", rng.choice([None, 0.0, round(rng.uniform(0, 130), 2), float(rng.randrange(1, 9))]))
        for i in range(1500)
    ]
    assert sorted(rows(graph.edges_similar(frame(spark, GAME_DDL, data)))) == sorted(brute_force(data))


def test_purchase_windows_on_random_events(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    events = [
        (start + timedelta(milliseconds=rng.randrange(600_000)), rng.randrange(3), rng.randrange(99, 6000) / 100,
         rng.choice([None, 0, 25, 50, 75]))
        for _ in range(3000)
    ]
    counts, micros = defaultdict(int), defaultdict(list)
    for when, game, price, discount in events:
        key = (start + timedelta(seconds=(when - start).total_seconds() // 30 * 30), game)
        counts[key] += 1
        if discount is not None:
            micros[key].append(round(price * 10_000) * (100 - discount))
    want = sorted((*k, n, sum(micros[k]) / 1e6 if micros[k] else None) for k, n in counts.items())
    df = frame(spark, "event_time timestamp, game_id int, price_usd double, discount_pct int", events)
    assert rows(aggregate_windows(df, "purchases"), "window_start", "game_id") == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="0123456789,. a", max_size=8), st.text(alphabet="0123456789, ", max_size=8)),
                min_size=1, max_size=40))
def test_owners_midpoint_follows_its_definition(spark, ends):
    def expected(value):
        try:
            low, high = (int(p.strip(" ").replace(",", "")) for p in value.split("..")[:2])
            return (low + high) // 2
        except ValueError:
            return 0

    values = [f"{low} .. {high}" for low, high in ends]
    df = frame(spark, "i int, v string", list(enumerate(values)))
    got = [r[0] for r in df.orderBy("i").select(text.owners_midpoint(F.col("v"))).collect()]
    assert got == [expected(v) for v in values]


def test_request_rollups_as_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    log = frame(spark, "ts timestamp, handler string, status int, duration_s double",
                [(start + timedelta(seconds=7 * i), "a" if i % 3 else "b", 500 if i % 10 == 0 else 200, i / 100) for i in range(200)])
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    forms = {
        "rate": lambda df, **o: requests.request_rate(df, "handler", **o),
        "errors": requests.error_rate,
        "latency": requests.latency_quantiles,
    }
    for name, form in forms.items():
        query = (
            form(stream, watermark="1 minute").writeStream.format("memory").queryName(name).outputMode("complete")
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert rows(spark.table(name)) == rows(form(log))
