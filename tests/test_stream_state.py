"""State in streams: entries that expire, sessions, matches and copies, over several deliveries and restarts."""

import json
import os
import time
from datetime import datetime, timedelta

from helpers import frame, plan_of, rows
from ludoscope.operators import live, matching, play_sessions, unique
from ludoscope.sources import tables
from ludoscope.streaming import jobs, keyed_state, sinks
from pyspark.sql import functions as F

NOW = {"availableNow": True}
T = datetime(2024, 1, 1, 12)
WISHES = "window_start timestamp, game_id int, num_added bigint, num_removed bigint, net_added bigint"


def at(seconds):
    return T + timedelta(seconds=seconds)


def drop_rows(folder, number, records):
    """A file of JSON lines whose modification time follows its number, so that batches keep this order."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:03d}.json"
    with open(path, "w") as out:
        out.write("\n".join(json.dumps(r, default=str) for r in records) + "\n")
    stamp = time.time() - 1000 + number
    os.utime(path, (stamp, stamp))


def collected(spark, stream, target, progress):
    """Runs the stream over what there is and returns all that it has given out so far, batch by batch."""

    def take(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(**NOW).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target), query


# -- entries that expire ---------------------------------------------------------------------------


def test_silent_keys_expire_and_a_restart_goes_on(spark, tmp_path):
    root, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    session = spark.newSession()
    for key, value in {**keyed_state.STATE_STORE, "spark.sql.shuffle.partitions": "2"}.items():
        session.conf.set(key, value)
    write = sinks.history_writer(root, "wishlist")
    everything = []

    def deliver(number, *windows):
        everything.extend(windows)
        write(frame(spark, WISHES, [(at(s), game, n, 0, n) for s, game, n in windows]), number)
        keyed_state.start_expiring(session, "wishlist", root, progress, trigger=NOW).awaitTermination()
        found = keyed_state.read_expiring(spark, root, "wishlist")
        got = {r["game_id"]: (r["window_start"], r["num_added"]) for r in found.collect()}
        assert found.count() == len(got)
        # The same by the batch form, at the time the newest window closes.
        newest = {}
        for s, game, n in everything:
            newest[s, game] = n
        table = frame(spark, WISHES, [(at(s), game, n, 0, n) for (s, game), n in newest.items()])
        table = table.withColumn("updated_at", F.col("window_start") + F.expr("INTERVAL 30 SECONDS"))
        now = at(max(s for s, *_ in everything) + 30)
        state = live.live_state({"wishlist": table}, as_of=now)
        assert got == {r["game_id"]: (r["window_start"], r["num_added"]) for r in state.collect()}
        return got

    # Every call is a new query that starts from the checkpoint of the one before.
    assert set(deliver(0, (0, 1, 1), (30, 2, 2), (0, None, 9))) == {1, 2}
    assert deliver(1, (30, 2, 5), (300, 3, 1))[2] == (at(30), 5)  # a window again, with more in it
    assert set(deliver(2, (570, 3, 1))) == {1, 2, 3}
    assert set(deliver(3, (600, 3, 1))) == {2, 3}  # game 1 has been silent for 600 seconds
    assert set(deliver(4, (30, 2, 6), (0, 1, 7))) == {2, 3}  # a window that old revives no game
    assert set(deliver(5, (5000, 4, 1))) == {4}
    assert set(deliver(6, (5030, 1, 1))) == {1, 4}
    assert len(tables.folders(spark, f"{keyed_state.expiring_path(root, 'wishlist')}/version=*")) == 2


# -- play sessions ---------------------------------------------------------------------------------

SESSION = "event_id string, event_type string, event_time timestamp, user_id string, game_id int"


def played(i, second, kind="session_heartbeat", user="u", game=1):
    return {"event_id": str(i), "event_type": kind, "event_time": at(second).isoformat(), "user_id": user, "game_id": game}


def test_an_event_joins_two_sessions(spark, tmp_path):
    folder, target, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    drop_rows(folder, 1, [played(1, 0, "session_start"), played(2, 3000, "session_end"), played(3, 100, user="v")])
    drop_rows(folder, 2, [played(4, 1500)])  # between the two, and in time
    drop_rows(folder, 3, [played(5, 40_000)])
    drop_rows(folder, 4, [played(9, 40_001)])
    drop_rows(folder, 5, [played(6, 10, "session_end"), played(7, 90_000, user="w")])  # the first is far too late

    def run():
        stream = spark.readStream.schema(SESSION).option("maxFilesPerTrigger", 1).json(folder)
        found, _ = collected(spark, play_sessions.play_sessions(stream, watermark="1 hour"), target, progress)
        return rows(found.select("user_id", "session_start", "session_end", "num_events", "num_starts", "num_ends", "completed"))

    want = [("u", at(0), at(3000), 3, 1, 1, True), ("u", at(40_000), at(40_001), 2, 0, 0, False), ("v", at(100), at(100), 1, 0, 0, False)]
    assert run() == want
    drop_rows(folder, 6, [played(8, 200_000)])
    assert run() == [*want, ("w", at(90_000), at(90_000), 1, 0, 0, False)]


def test_sessions_of_a_batch(spark):
    kinds = ("session_start", "session_heartbeat", "session_end")
    seconds = [0, 1800, 3600, 5401, 9000, 9001, 9001, 20_000, 21_799, 23_600]
    events = [(str(k), kinds[k % 3], at(s), "u", 1) for k, s in enumerate(seconds)]
    events += [("a", "other", at(5), None, 1), ("b", "session_end", None, "u", 1), ("c", None, at(0), "u", 2)]
    found = play_sessions.play_sessions(frame(spark, SESSION, events))
    got = rows(found.select("user_id", "game_id", "session_start", "session_end", "num_events", "played_seconds"))
    assert got == sorted([
        ("u", 1, at(0), at(3600), 3, 3600.0), ("u", 1, at(5401), at(5401), 1, 0.0), ("u", 1, at(9000), at(9001), 3, 1.0),
        ("u", 1, at(20_000), at(21_799), 2, 1799.0), ("u", 1, at(23_600), at(23_600), 1, 0.0), (None, 1, at(5), at(5), 1, 0.0),
        ("u", 2, at(0), at(0), 1, 0.0)], key=repr)
    assert play_sessions.play_sessions(frame(spark, SESSION, [])).count() == 0


def test_a_busy_player_sends_on_panes_not_events(spark):
    busy = spark.range(20_000).select(
        F.col("id").cast("string").alias("event_id"), F.lit("session_heartbeat").alias("event_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("event_time"), F.lit("u").alias("user_id"), F.lit(1).alias("game_id"))
    found = play_sessions.play_sessions(busy)
    assert rows(found.select("num_events", "played_seconds")) == [(20_000, 19_999.0)]
    first = plan_of(found).split("MergingSessions")[1]
    assert first.count("Exchange hashpartitioning") == 2 and "partial_count" in first.split("Exchange hashpartitioning")[-1]


# -- matches ---------------------------------------------------------------------------------------

BOUGHT, RATED = "event_id string, event_time timestamp, user_id string", "event_id string, event_time timestamp, user_id string, rating int"


def bought(i, hours, user="u"):
    return {"event_id": i, "event_time": at(3600 * hours).isoformat(), "user_id": user}


def test_matches_of_two_streams(spark, tmp_path):
    """Matches as they come, an unmatched purchase once it can have none, late rows on either side left out."""
    a, b, target, progress = (str(tmp_path / p) for p in ("a", "b", "out", "progress"))
    week = 7 * 24

    def run():
        sides = [
            spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder) for ddl, folder in ((BOUGHT, a), (RATED, b))
        ]
        found = matching.followed_by(*sides, by=("user_id",), watermarks=("1 hour", "1 hour"))
        out, _ = collected(spark, found, target, progress)
        return rows(out.select("purchase_event_id", "review_event_id"))

    drop_rows(a, 1, [bought("p1", 0), bought("p2", 1, "v"), bought("p3", 2, None), bought("p4", week + 5, "x")])
    drop_rows(b, 1, [{**bought("r1", 0), "rating": 5}, {**bought("r0", -1), "rating": 1}, {**bought("r2", week + 5, "x"), "rating": 2}])
    drop_rows(a, 2, [bought("p5", week + 6)])
    drop_rows(b, 2, [{**bought("r3", week + 6), "rating": 3}, {**bought("r4", week + 6, "w"), "rating": 3}])
    got = run()
    assert ("p1", "r1") in got and ("p4", "r2") in got and ("p5", "r3") in got
    assert ("p1", "r0") not in got and ("p1", "r3") not in got  # before it, and more than a week after it
    # Both watermarks are past week + 5: purchases up to hour 5 that nothing followed are given out, once.
    assert ("p2", None) in got and ("p3", None) in got and len(got) == 5
    drop_rows(a, 3, [bought("late", 3), bought("p6", 3 * week)])
    drop_rows(b, 3, [{**bought("r5", 4, "v"), "rating": 3}, {**bought("r6", 3 * week, "z"), "rating": 3}])
    again = run()  # from the checkpoint: nothing twice, nothing for the late ones
    assert again == got
    drop_rows(a, 4, [bought("p7", 9 * week)])
    drop_rows(b, 4, [{**bought("r7", 9 * week, "z"), "rating": 3}])
    assert run() == sorted([*got, ("p6", None)], key=repr)


def test_matches_of_a_batch(spark):
    first = frame(spark, BOUGHT, [("p1", at(0), "u"), ("p1", at(0), "u"), ("p2", at(0), None), ("p3", None, "u"), ("p4", at(9), "w")])
    second = frame(spark, RATED, [("r1", at(0), "u", 1), ("r2", at(7 * 86_400), "u", 2), ("r3", at(7 * 86_400 + 1), "u", 3), ("r4", at(0), None, 4), ("r5", at(8), "w", 5)])
    got = rows(matching.followed_by(first, second, by=("user_id",)).select("purchase_event_id", "review_event_id"))
    assert got == sorted([("p1", "r1"), ("p1", "r2")] * 2 + [("p2", None), ("p3", None), ("p4", None)], key=repr)
    none = matching.followed_by(first, second.limit(0), by=("user_id",))
    assert none.filter("review_event_id is null").count() == 5


# -- copies ----------------------------------------------------------------------------------------


def test_copies_over_deliveries_count_once_and_state_stays_small(spark, tmp_path):
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    ddl = "event_id string, event_type string, event_time timestamp, user_id string, game_id int, action string, source string"
    for n in range(8):  # every delivery repeats the one before, and itself
        events = [played(f"{d}-{k}", 100 * d + k) for d in {max(0, n - 1), n} for k in range(50)]
        drop_rows(folder, n, events + events)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder)
    query = jobs.start_raw(stream, "wishlist", root, progress, trigger=NOW, unique_within="10 seconds")
    query.awaitTermination()
    ids = [r[0] for r in sinks.read_raw(spark, root, "wishlist").select("event_id").collect()]
    assert sorted(ids) == sorted(f"{d}-{k}" for d in range(8) for k in range(50))
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) <= 120 and held[-1] <= 20  # not the 400 ids that have passed


def test_copies_of_a_batch(spark):
    events = frame(spark, "event_id string, event_time timestamp, x int", [
        ("a", at(5), 1), ("a", at(3), 2), ("a", None, 3), ("b", None, 4), (None, at(1), 5), (None, at(1), 5)])
    got = rows(unique.unique_events(events).select("event_id", "event_time", "x"))
    assert got == sorted([("a", at(3), 2), ("b", None, 4), (None, at(1), 5), (None, at(1), 5)], key=repr)
    assert unique.unique_events(events.limit(0)).count() == 0
