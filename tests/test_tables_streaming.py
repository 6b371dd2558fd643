"""Stored tables and the standing queries, with late rows, retries and restarts."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

from helpers import frame, plan_of, rows
from ludoscope.operators.live import live_state
from ludoscope.operators.windows import aggregate_windows, latest_version
from ludoscope.plans import anomalies
from ludoscope.plans.materialise import as_table, stored
from ludoscope.sources import tables, topics
from ludoscope.streaming import jobs, sinks
from pyspark.sql import functions as F

NOW = {"availableNow": True}
T = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def wish(i, second, game=1, action="added"):
    when = (T + timedelta(seconds=second)).isoformat()
    return json.dumps({"event_id": str(i), "event_type": "wishlist_update", "event_time": when,
                       "user_id": "u", "game_id": game, "action": action})


def drop_file(folder, number, lines):
    """A file whose modification time follows its number, so that batches keep this order."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:03d}.json"
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    stamp = time.time() - 1000 + number
    os.utime(path, (stamp, stamp))


def run(spark, folder, root, progress, topic="wishlist"):
    stream = topics.read_topic(spark, topic, path=folder, options={"maxFilesPerTrigger": "1"})
    query = jobs.start_aggregate(stream, topic, root, progress, trigger=NOW)
    query.awaitTermination()


def test_updates_collapse_to_the_batch_result(spark, tmp_path):
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    first = [wish(1, 0), wish(2, 29), "{broken"]
    second = [wish(3, 1, action="removed"), wish(4, 30), wish(5, 2, game=2)]
    drop_file(folder, 1, first)
    drop_file(folder, 2, second)
    run(spark, folder, root, progress)
    drop_file(folder, 3, [wish(6, 31), wish(7, 5)])
    run(spark, folder, root, progress)
    versions = spark.read.parquet(sinks.history_path(root, "wishlist"))
    assert versions.filter("game_id = 1").count() > 2
    batch = aggregate_windows(topics.parse_messages(spark.read.text(folder), "wishlist"), "wishlist")
    final = sinks.read_history(spark, root, "wishlist", since="2024-01-01")
    assert rows(final, "window_start", "game_id") == rows(batch, "window_start", "game_id")
    want = rows(final, "window_start", "game_id")
    assert sinks.compacted_upto(spark, root, "wishlist") is None
    sinks.compact_history(spark, root, "wishlist")
    sinks.compact_history(spark, root, "wishlist")
    done = sinks.compacted_upto(spark, root, "wishlist")
    assert done == versions.agg(F.max("batch_id")).first()[0]
    assert rows(sinks.read_history(spark, root, "wishlist"), "window_start", "game_id") == want
    # A later batch changes one window and adds another.
    drop_file(folder, 4, [wish(8, 32), wish(9, 61)])
    run(spark, folder, root, progress)
    batch = aggregate_windows(topics.parse_messages(spark.read.text(folder), "wishlist"), "wishlist")
    want = rows(batch, "window_start", "game_id")
    assert rows(sinks.read_history(spark, root, "wishlist"), "window_start", "game_id") == want
    sinks.compact_history(spark, root, "wishlist")
    assert sinks.compacted_upto(spark, root, "wishlist") > done
    assert rows(sinks.read_history(spark, root, "wishlist", since="2024-01-01"), "window_start", "game_id") == want
    assert sinks.read_history(spark, root, "wishlist", since="2024-01-01").count() == len(want)


def test_late_rows(spark, tmp_path):
    """Counted in the batch right after the watermark passed the window, dropped one batch later."""
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    drop_file(folder, 1, [wish(1, 0)])
    drop_file(folder, 2, [wish(2, 100)])
    drop_file(folder, 3, [wish(3, 1), wish(4, 101)])
    drop_file(folder, 4, [wish(5, 2), wish(6, 102)])
    run(spark, folder, root, progress)
    final = {r.window_start: r.num_added for r in sinks.read_history(spark, root, "wishlist").collect()}
    assert final == {datetime(2024, 1, 1, 12, 0, 0): 2, datetime(2024, 1, 1, 12, 1, 30): 3}


WISHES = "window_start timestamp, game_id int, num_added bigint, num_removed bigint, net_added bigint"


def take(spark, root, batch, batch_id, **settings):
    sinks.history_writer(root, "wishlist")(batch, batch_id)
    sinks.refresh_live(spark, root, "wishlist", batch_id, **settings)


def test_retried_batch_replaces_its_rows(spark, tmp_path):
    root = str(tmp_path)
    batch = frame(spark, WISHES, [(datetime(2024, 1, 1), 1, 1, 0, 1), (datetime(2024, 1, 2), 1, 1, 0, 1)])
    for _ in range(2):
        take(spark, root, batch, 7)
    assert spark.read.parquet(sinks.history_path(root, "wishlist")).count() == 2
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    entries = sinks.read_live(spark, root, "wishlist", as_of=now)
    state = live_state({"wishlist": entries}, as_of=now)
    assert rows(state.select("game_id", "window_start", "net_added")) == [(1, datetime(2024, 1, 2), 1)]
    assert live_state({"wishlist": entries}, as_of=now + timedelta(hours=1)).count() == 0


class Clock(datetime):
    at = datetime(2024, 1, 1, 0, 59, 59, tzinfo=timezone.utc)

    @classmethod
    def now(cls, tz=None):
        return cls.at


def test_live_state_is_one_row_per_key_and_forgets(spark, tmp_path, monkeypatch):
    """A key that is not updated leaves the files; a retried batch leaves what one run leaves."""
    monkeypatch.setattr(sinks, "datetime", Clock)
    root, day = str(tmp_path), datetime(2024, 1, 1)

    def at(second):
        Clock.at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
        return Clock.at.replace(tzinfo=None)

    def entries(as_of):
        found = sinks.read_live(spark, root, "wishlist", as_of=as_of)
        return rows(found.select("game_id", "net_added", "updated_at"), "game_id")

    start = at(0)
    take(spark, root, frame(spark, WISHES, [(day, 1, 1, 0, 1), (day, 2, 2, 0, 2), (day, None, 5, 0, 5)]), 0)
    assert entries(start) == [(1, 1, start), (2, 2, start)]
    later = at(300)
    for _ in range(2):  # the same window again, with more in it, and the batch twice
        take(spark, root, frame(spark, WISHES, [(day, 1, 3, 0, 3)]), 1)
        assert entries(later) == [(1, 3, later), (2, 2, start)]
    take(spark, root, frame(spark, WISHES, []), 2)
    assert entries(later) == [(1, 3, later), (2, 2, start)]
    end = at(700)  # game 2 has been silent for more than 600 seconds
    take(spark, root, frame(spark, WISHES, [(day - timedelta(days=1), 1, 9, 0, 9)]), 3)
    assert entries(end) == [(1, 3, later)]
    stored_rows = [spark.read.parquet(f).count() for f in tables.folders(spark, f"{sinks.live_path(root, 'wishlist')}/version=*")]
    assert len(stored_rows) == 2 and stored_rows[-1] == 1
    assert len(tables.folders(spark, f"{sinks.live_path(root, 'wishlist')}_position/at=*")) == 2


def test_reading_some_days_reads_only_their_folders(spark, tmp_path):
    days = [datetime(2024, 1, d) for d in range(1, 9)]
    sinks.history_writer(str(tmp_path), "wishlist")(frame(spark, WISHES, [(d, 1, 1, 0, 1) for d in days]), 0)
    found = sinks._versions(spark, sinks.history_path(str(tmp_path), "wishlist"), "wishlist", "2024-01-07")
    files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 2 and all("date=2024-01-07" in f or "date=2024-01-08" in f for f in files)
    assert "PartitionFilters: [((cast(date" in plan_of(found) or "PartitionFilters: [((date" in plan_of(found)
    assert sinks.read_history(spark, str(tmp_path), "wishlist", since="2024-02-01").count() == 0


def test_since_loses_neither_rejects_nor_rows_of_the_future(spark, tmp_path):
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    far = 86_400 * 365 * 9
    drop_file(folder, 1, [wish(1, 0), wish(2, far), "{broken", wish(3, -86_400 * 400)])
    stream = topics.read_topic(spark, "wishlist", path=folder)
    jobs.start_raw(stream, "wishlist", root, progress, trigger=NOW).awaitTermination()
    for since in (None, "2020-01-01"):
        assert rows(sinks.read_raw(spark, root, "wishlist", since=since).select("event_id")) == [("1",), ("2",), ("3",)]
    for since in (None, "2020-01-01", "2023-06-01", "2024-01-01"):
        rejects = sinks.read_raw(spark, root, "wishlist", "reject", since=since)
        assert [r["_raw"] for r in rejects.collect()] == ["{broken"]
    assert rows(sinks.read_raw(spark, root, "wishlist", since="2024-01-01").select("event_id")) == [("1",), ("2",)]
    run(spark, folder, root, str(tmp_path / "p2"))
    assert sinks.read_history(spark, root, "wishlist", since="2024-01-01").count() == 2


def test_covered_batches_and_replaced_days_are_removed(spark, tmp_path):
    root, day = str(tmp_path), datetime(2024, 1, 1)
    write = sinks.history_writer(root, "wishlist")
    write(frame(spark, WISHES, [(day, 1, 1, 0, 1), (day + timedelta(days=1), 2, 1, 0, 1)]), 0)
    assert sinks.remove_covered(spark, root, "wishlist") == 0
    write(frame(spark, WISHES, [(day, 1, 2, 0, 2)]), 1)
    sinks.compact_history(spark, root, "wishlist")
    assert sinks.remove_covered(spark, root, "wishlist") == 3
    want = [(day, 1, 2), (day + timedelta(days=1), 2, 1)]
    got = ("window_start", "game_id", "num_added")
    assert rows(sinks.read_history(spark, root, "wishlist").select(*got), "game_id") == want
    write(frame(spark, WISHES, [(day, 1, 5, 0, 5)]), 2)
    want[0] = (day, 1, 5)
    assert rows(sinks.read_history(spark, root, "wishlist").select(*got), "game_id") == want
    sinks.compact_history(spark, root, "wishlist")
    assert sinks.remove_covered(spark, root, "wishlist") == 2
    assert rows(sinks.read_history(spark, root, "wishlist").select(*got), "game_id") == want
    assert rows(sinks.read_history(spark, root, "wishlist", since="2024-01-02").select(*got), "game_id") == want[1:]


def test_a_refresh_by_an_absent_day_changes_nothing(spark, tmp_path):
    root, target = str(tmp_path / "dated"), str(tmp_path / "table")
    tables.write_dated(frame(spark, "x string", [("1",), ("one",)]), root, "s", "2024-01-01")
    got = tables.full_refresh(spark, root, "s", "2024-01-01", "x INT", target, required=("x",), as_of="2024-01-31")
    assert rows(got.select("x")) == [(1,)]
    assert [(r.original, r.problems) for r in tables.read_refresh_rejects(spark, target).collect()] == [('{"x":"one"}', "x")]
    try:
        tables.full_refresh(spark, root, "s", "2024-01-02", "x INT", target)
        raise AssertionError("no error")
    except ValueError:
        pass
    assert rows(tables.read_refreshed(spark, target).select("x")) == [(1,)]
    tables.write_dated(frame(spark, "x string", [("2",)]), root, "s", "2024-01-02")
    before = tables.read_refreshed(spark, target)
    tables.full_refresh(spark, root, "s", "2024-01-02", "x INT", target, as_of="2024-01-31")
    assert rows(tables.read_refreshed(spark, target).select("x")) == [(2,)]
    assert rows(before.select("x")) == [(1,)]  # a reader of the load before still finds its files
    tables.full_refresh(spark, root, "s", "2024-01-02", "x INT", target, as_of="2024-01-31")
    assert [f.rsplit("/", 1)[1] for f in tables.folders(spark, f"{target}/load=*")] == ["load=1", "load=2"]
    files = tables.read_refreshed(spark, target).inputFiles()
    assert files and all("load=2" in f for f in files)


def test_raw_copy_keeps_events_and_sets_rejects_apart(spark, tmp_path):
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    drop_file(folder, 1, [wish(1, 0), "{broken", wish(2, 86_400)])
    stream = topics.read_topic(spark, "wishlist", path=folder)
    jobs.start_raw(stream, "wishlist", root, progress, trigger=NOW).awaitTermination()
    raw = sinks.read_raw(spark, root, "wishlist")
    assert rows(raw.select("event_id", F.col("date").cast("string"))) == [("1", "2024-01-01"), ("2", "2024-01-02")]
    rejects = sinks.read_raw(spark, root, "wishlist", "reject")
    assert [r["_raw"] for r in rejects.collect()] == ["{broken"]
    assert rows(sinks.read_raw(spark, root, "wishlist", since="2024-01-02").select("event_id")) == [("2",)]


def test_eight_standing_queries(spark, tmp_path):
    folder, root, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    for topic in topics.TOPICS:
        drop_file(f"{folder}/{topic}", 1, [wish(1, 0)])
    running = jobs.start_all(
        lambda t: topics.read_topic(spark, t, path=f"{folder}/{t}"), root, progress,
        aggregate_trigger=NOW, raw_trigger=NOW)
    assert len({q.name for q in running}) == 8
    jobs.run_until_any_ends(spark)
    for query in running:
        query.awaitTermination()
    spark.streams.resetTerminated()
    assert all(q.exception() is None for q in running)
    assert sinks.read_history(spark, root, "wishlist").count() == 1


def test_append_mode_emits_closed_windows_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_file(folder, 1, [wish(1, 0)])
    drop_file(folder, 2, [wish(2, 100)])
    stream = topics.read_topic(spark, "wishlist", path=folder, options={"maxFilesPerTrigger": "1"})
    closed = aggregate_windows(stream, "wishlist", watermark="10 seconds")
    query = closed.writeStream.format("memory").queryName("closed").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
    query.awaitTermination()
    assert spark.table("closed").select("num_added").collect()[0][0] == 1 and spark.table("closed").count() == 1


def test_topic_names_are_checked(spark):
    for call in (lambda: topics.read_topic(spark, "x", path="p"), lambda: topics.read_topic(spark, "reviews")):
        try:
            call()
            raise AssertionError("no error")
        except ValueError:
            pass


def test_incremental_load_takes_each_file_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    ddl = "window_start BIGINT, game_id STRING, num_purchases BIGINT, revenue_net_usd DOUBLE"

    def load():
        tables.load_incremental(spark, source, ddl, target, tables.WINDOW_TABLES["purchases"], progress,
                                prepare=tables.nanos_to_timestamp, required=("window_start", "game_id"), as_of="2024-01-31")

    nanos = 1_704_110_400_123_456_789
    frame(spark, ddl, [(nanos, "1", 2, 3.0), (nanos, "one", 2, 3.0), (None, "2", 1, 1.0)]).write.parquet(f"{source}/a")
    load()
    load()
    frame(spark, ddl, [(nanos, "3", 2, 3.0)]).write.parquet(f"{source}/b")
    load()
    got = rows(tables.read_loaded(spark, target).select("window_start", "game_id"), "game_id")
    assert got == [(datetime(2024, 1, 1, 12, 0, 0, 123_456), 1), (datetime(2024, 1, 1, 12, 0, 0, 123_456), 3)]
    rejects = {r.problems: r.original for r in tables.read_rejects(spark, target).collect()}
    assert set(rejects) == {"game_id", "window_start"} and '"game_id":"one"' in rejects["game_id"]
    assert tables.read_loaded(spark, target, since="2024-01-31").count() == 2


def test_dated_write_replaces_one_day_and_ignores_empty(spark, tmp_path):
    root = str(tmp_path)
    tables.write_dated(frame(spark, "x int", [(1,)]), root, "s", "2024-01-01")
    tables.write_dated(frame(spark, "x int", [(2,)]), root, "s", "2024-01-02")
    tables.write_dated(frame(spark, "x int", [(3,), (4,)]), root, "s", "2024-01-02")
    tables.write_dated(frame(spark, "x int", []), root, "s", "2024-01-02")
    assert rows(tables.read_dated(spark, root, "s", "2024-01-01")) == [(1,)]
    assert rows(tables.read_dated(spark, root, "s", "2024-01-02")) == [(3,), (4,)]
    plan = tables.read_dated(spark, root, "s", "2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_rejects_name_the_bad_columns(spark):
    df = frame(spark, "a string, b string", [("1", "2.5"), ("x", "y"), (None, "1"), ("2", None)])
    good, bad = tables.split_rejects(df, "a INT, b DOUBLE", required=("a",))
    assert rows(good) == [(1, 2.5), (2, None)]
    assert rows(bad) == [("x", "y", "a,b"), (None, "1", "a")]


def test_findings_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "kg")
    df = frame(spark, "anomaly_type string, severity string", [("t", "High"), ("t", "High")])
    anomalies.replace_findings(df, path, "2024-01-31")
    assert anomalies.replace_findings(df, path, "2024-01-31").count() == 2
    assert rows(anomalies.summary(df)) == [("t", "High", 2)]


def test_stored_results_cut_the_plan(spark, tmp_path):
    df = spark.range(5).withColumn("y", F.col("id") * 2)
    kept = stored(df, "test")
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 5
    as_table(df, str(tmp_path), "doubles")
    assert spark.sql("select sum(y) from doubles").first()[0] == 20


def test_latest_version_reads_each_window_once(spark):
    df = frame(spark, "window_start timestamp, game_id int, num_added bigint, batch_id bigint",
               [(datetime(2024, 1, 1), 1, n, n) for n in range(50)])
    assert rows(latest_version(df)) == [(datetime(2024, 1, 1), 1, 49)]
