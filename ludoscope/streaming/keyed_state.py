"""Live state as keyed state of a stream: one entry per key, removed by a timer in event time.

The stream reads the windows that a standing aggregate has written into its history, which are already
reduced, so a game with a third of all events adds a row for each batch. The state of a key is its newest
window; a timer removes it once other games' windows have gone on for the time to live. A silent key so
leaves without any event of its own, and a restart goes on from the checkpoint with state and timers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.live import TTL_SECONDS
from ..sources.tables import WINDOW_TABLES, recorded_position
from ..sources.topics import check_topic
from . import sinks

#: Keyed state with timers needs this state store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def history_stream(spark: SparkSession, root: str, topic: str, **options) -> DataFrame:
    """Windows as the standing aggregate writes them, with the ``version`` (batch) they come from."""
    files = spark.readStream.schema(WINDOW_TABLES[check_topic(topic)]).option("recursiveFileLookup", True)
    version = F.regexp_extract(F.col("_metadata.file_path"), "batch_id=([0-9]+)", 1).cast("bigint")
    return files.options(**options).parquet(sinks.history_path(root, topic)).withColumn("version", version)


def _newest_window(key_column: str, columns: list[str]) -> StatefulProcessor:
    # Defined here, so that it travels by value and the executors need not have this package.
    class NewestWindow(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.newest = handle.getValueState("newest", "window_start long, version long, closes long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            best, place = None, None
            for frame in rows:
                frame = frame.sort_values(["window_start", "version"], kind="stable").tail(1)
                found = (int(frame["window_start"].iloc[0].value), int(frame["version"].iloc[0]))
                if place is None or found > place:
                    best, place = frame, found
            old = self.newest.get() if self.newest.exists() else None
            closes = best["closes"].iloc[0].value // 1_000_000
            if (old and place <= (old[0], old[1])) or closes <= timerValues.getCurrentWatermarkInMs():
                return
            if old:
                self.handle.deleteTimer(old[2])
            # A timer rings once the watermark is beyond it.
            self.handle.registerTimer(closes - 1)
            self.newest.update((*place, closes - 1))
            yield pd.DataFrame({key_column: [key[0]], **{c: best[c].to_list() for c in columns}, "expired": [False]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            self.newest.clear()
            yield pd.DataFrame({key_column: [key[0]], **{c: [None] for c in columns}, "expired": [True]})

        def close(self):
            pass

    return NewestWindow()


def expiring(
    windows: DataFrame, *, key: str = "game_id", ttl_seconds: int = TTL_SECONDS, window_seconds: int = 30
) -> DataFrame:
    """Changes of the live state: a key's new entry, or that its entry has ``expired``.

    ``windows`` stream with ``window_start``, ``version`` and measures. An entry expires when the newest
    window of any key closes ``ttl_seconds`` or more after its own. Windows that are that late when they
    arrive, older than the key's entry, or without a key change nothing.
    """
    closes = F.col("window_start") + F.make_dt_interval(secs=F.lit(window_seconds))
    rows = windows.filter(F.col(key).isNotNull()).withColumn("closes", closes)
    columns = [c for c in rows.columns if c not in (key, "version")]
    fields = [rows.schema[key], *[T.StructField(c, rows.schema[c].dataType) for c in columns], T.StructField("expired", T.BooleanType())]
    return rows.withWatermark("closes", f"{ttl_seconds} seconds").groupBy(key).transformWithStateInPandas(
        statefulProcessor=_newest_window(key, columns),
        outputStructType=T.StructType(fields),
        outputMode="update",
        timeMode="eventTime",
    )


def expiring_path(root: str, topic: str) -> str:
    return f"{root}/live_expiring/{topic}"


def start_expiring(
    spark: SparkSession,
    topic: str,
    root: str,
    checkpoints: str,
    *,
    key: str = "game_id",
    ttl_seconds: int = TTL_SECONDS,
    window_seconds: int = 30,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Keep a table of the live entries of a topic from its history; the session needs ``STATE_STORE``."""
    changes = expiring(
        history_stream(spark, root, topic, **options), key=key, ttl_seconds=ttl_seconds, window_seconds=window_seconds
    )
    path = expiring_path(root, topic)

    def take(batch: DataFrame, batch_id: int) -> None:
        def merge(state: DataFrame | None) -> DataFrame:
            rows = batch.withColumn("_changed", F.lit(1))
            if state is not None:
                rows = state.withColumns({"expired": F.lit(False), "_changed": F.lit(0)}).unionByName(rows)
            rest = [c for c in rows.columns if c not in (key, "_changed")]
            last = F.max_by(F.struct(*rest), "_changed").alias("last")
            return rows.groupBy(key).agg(last).filter(~F.col("last.expired")).select(key, *[f"last.{c}" for c in rest if c != "expired"])

        sinks.replace_keyed(batch.sparkSession, path, batch_id, merge)

    return (
        changes.writeStream.queryName(f"live_{topic}")
        .foreachBatch(take)
        .option("checkpointLocation", f"{checkpoints}/live_{topic}")
        .outputMode("update")
        .trigger(**(trigger or {"processingTime": "15 seconds"}))
        .start()
    )


def read_expiring(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """The live entries, one row per key."""
    path = expiring_path(root, topic)
    return spark.read.parquet(f"{path}/version={recorded_position(spark, path)}")
