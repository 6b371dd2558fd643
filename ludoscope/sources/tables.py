"""Stored tables: dated folders, exactly-once incremental loads, rejects and load audits."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

# Columns of the stored tables.
CATALOG_A_TABLE = (
    "igdb_id INT, name STRING, summary STRING, rating DOUBLE, rating_count INT, "
    "release_date DATE, genres STRING, themes STRING, platforms STRING, keywords STRING, "
    "game_modes STRING, developer STRING, publisher STRING"
)
CATALOG_B_TABLE = (
    "appid INT, name STRING, developer STRING, publisher STRING, score_rank STRING, "
    "owners_range STRING, owners_estimate BIGINT, average_forever INT, average_2weeks INT, "
    "median_forever INT, median_2weeks INT, ccu INT, price_usd DOUBLE, initialprice_usd DOUBLE, "
    "discount_pct INT, positive INT, negative INT, review_score DOUBLE, tags STRING, "
    "languages STRING, genre STRING"
)
WINDOW_TABLES = {
    "purchases": "window_start TIMESTAMP, game_id INT, num_purchases BIGINT, revenue_net_usd DOUBLE",
    "reviews": (
        "window_start TIMESTAMP, game_id INT, num_reviews BIGINT, avg_rating DOUBLE, "
        "recommend_pct DOUBLE"
    ),
    "sessions": (
        "window_start TIMESTAMP, game_id INT, num_starts BIGINT, num_ends BIGINT, "
        "avg_duration_sec DOUBLE"
    ),
    "wishlist": (
        "window_start TIMESTAMP, game_id INT, num_added BIGINT, num_removed BIGINT, "
        "net_added BIGINT"
    ),
}


#: Loads of a refreshed table that stay beside the recorded one, for their readers.
KEPT_LOADS = 1


def columns_of(ddl: str) -> list[tuple[str, str]]:
    return [tuple(f.replace(" NOT NULL", "").split(" ", 1)) for f in ddl.split(", ")]


def write_dated(df: DataFrame, root: str, source: str, day: date | str) -> str:
    """Replace one day of ``source`` and leave the other days alone; no rows, no change."""
    path = f"{root}/{source}"
    (
        df.withColumn("date", F.lit(str(day)).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("date")
        .parquet(path)
    )
    return path


def read_dated(spark: SparkSession, root: str, source: str, day: date | str) -> DataFrame:
    """One day of ``source``; the date is a folder, so other days are never listed for reading."""
    rows = spark.read.parquet(f"{root}/{source}")
    return rows.filter(F.col("date") == F.lit(str(day)).cast("date")).drop("date")


def with_load_time(df: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    return df.withColumn("_loaded_at", times.anchor(as_of))


def judged(df: DataFrame, ddl: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Cast to ``ddl`` and add ``_problems``, the columns that do not fit (NULL when all do).

    A value that cannot be cast and a missing required value are problems.
    """
    columns, problems = [], []
    for name, kind in columns_of(ddl):
        value = F.col(name).try_cast(kind)
        wrong = value.isNull() if name in required else F.col(name).isNotNull() & value.isNull()
        columns.append(value.alias(name))
        problems.append(F.when(wrong, F.lit(name)))
    named = F.nullif(F.concat_ws(",", *problems), F.lit(""))
    return df.select(*columns, named.alias("_problems"), F.struct(*df.columns).alias("_original"))


def split_rejects(df: DataFrame, ddl: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that fit ``ddl``, and the others with their original values and ``_problems``."""
    rows = judged(df, ddl, required)
    good = rows.filter(F.col("_problems").isNull()).drop("_problems", "_original")
    rejects = rows.filter(F.col("_problems").isNotNull()).select("_original.*", "_problems")
    return good, rejects


def full_refresh(
    spark: SparkSession,
    root: str,
    source: str,
    day: date | str,
    ddl: str,
    target: str,
    *,
    required: tuple[str, ...] = (),
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Replace ``target`` by one day of a dated source and return the new content.

    Rows that do not fit ``ddl`` are kept beside it (``read_refresh_rejects``). A day that is not there
    is refused and changes nothing. Each load is written aside, into a folder of its own, and becomes the
    content when it is complete and recorded; a reader of the load before is not disturbed, and older
    loads are removed.
    """
    rows = read_dated(spark, root, source, day)
    if not rows.take(1):
        raise ValueError(f"{source} has no rows of {day}; {target} stays as it is")
    bad = F.col("_problems").isNotNull()
    checked = with_load_time(judged(rows, ddl, required), as_of).withColumns(
        {
            "status": F.when(bad, "reject").otherwise("good"),
            "_original": F.when(bad, F.to_json("_original")),
        }
    )
    load = _current_load(spark, target) + 1
    checked.write.mode("overwrite").partitionBy("status").parquet(f"{target}/load={load}")
    record_position(spark, target, load)
    forget(spark, f"{target}/load={load - 1 - KEPT_LOADS}")
    return read_refreshed(spark, target)


def record_position(spark: SparkSession, path: str, position: int) -> None:
    """Note beside ``path`` how far it is complete, as the name of a folder; the largest number counts."""
    marks = f"{path}_position"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/at={position}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(mark)
    known = sorted(folders(spark, f"{marks}/at=*"), key=_noted)
    forget(spark, *known[:-2])


def recorded_position(spark: SparkSession, path: str) -> int | None:
    return max(map(_noted, folders(spark, f"{path}_position/at=*")), default=None)


def _noted(folder: str) -> int:
    return int(folder.rsplit("at=", 1)[1])


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders whose names fit the pattern, on whatever store they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove folders, on whatever store they are; absent ones are passed over."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _current_load(spark: SparkSession, target: str) -> int:
    current = recorded_position(spark, target)
    return -1 if current is None else current


def _newest_load(spark: SparkSession, target: str, status: str) -> DataFrame:
    """Rows of the recorded load; the folders of other loads are not looked at."""
    rows = spark.read.parquet(f"{target}/load={_current_load(spark, target)}")
    return rows.filter(F.col("status") == status).drop("status")


def read_refreshed(spark: SparkSession, target: str) -> DataFrame:
    return _newest_load(spark, target, "good").drop("_problems", "_original")


def read_refresh_rejects(spark: SparkSession, target: str) -> DataFrame:
    rejects = _newest_load(spark, target, "reject")
    return rejects.select(F.col("_original").alias("original"), F.col("_problems").alias("problems"))


def nanos_to_timestamp(df: DataFrame, name: str = "window_start") -> DataFrame:
    """Undo the epoch-nanosecond integers that some Parquet writers leave for timestamps."""
    return df.withColumn(name, times.epoch_nanos(F.col(name)))


def load_incremental(
    spark: SparkSession,
    source: str,
    source_ddl: str,
    target: str,
    target_ddl: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    required: tuple[str, ...] = (),
    as_of: datetime | str | None = None,
    max_files_per_trigger: int = 10_000,
) -> None:
    """Load the files that arrived since the last call, each exactly once.

    The checkpoint remembers the loaded files. A batch writes to a folder of its own and replaces it when it
    is retried, whatever the clock says, so a lost driver or executor cannot double rows. Good rows and
    rejects are written in one pass, into the subfolders ``status=good`` and ``status=reject``; a reject
    keeps its original values as JSON. Without ``as_of`` the load time is the start of this call.
    """
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = (
        spark.readStream.schema(source_ddl)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source)
    )
    if prepare:
        rows = prepare(rows)
    bad = F.col("_problems").isNotNull()
    checked = with_load_time(judged(rows, target_ddl, required), as_of).withColumns(
        {
            "status": F.when(bad, "reject").otherwise("good"),
            "_original": F.when(bad, F.to_json("_original")),
        }
    )

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("status").parquet(f"{target}/batch_id={batch_id}")

    (
        checked.writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_days(
    spark: SparkSession, root: str, column: str, since: str | None = None, ddl: str | None = None
) -> DataFrame:
    """Rows below ``root``, or those of the day ``since`` and later, and those without a day.

    The days are folders, so the filter picks files by their path. Nothing else is left out: rows dated
    beyond today stay, and so do rows without a date, which are the unreadable ones.
    """
    rows = (spark.read.schema(ddl) if ddl else spark.read).parquet(root)
    if since is None:
        return rows
    day = F.col(column).cast("date")
    return rows.filter((day >= F.lit(since).cast("date")) | day.isNull())


def _loaded(spark: SparkSession, target: str, status: str, since: str | None) -> DataFrame:
    rows = spark.read.parquet(target).filter(F.col("status") == status).drop("batch_id", "status")
    if since is not None:
        rows = rows.filter(F.col("_loaded_at") >= F.lit(since).cast("timestamp"))
    return rows


def read_loaded(spark: SparkSession, target: str, since: str | None = None) -> DataFrame:
    """Good rows, of loads from the day ``since`` on, which the files' statistics tell."""
    return _loaded(spark, target, "good", since).drop("_problems", "_original")


def read_rejects(spark: SparkSession, target: str, since: str | None = None) -> DataFrame:
    rejects = _loaded(spark, target, "reject", since)
    return rejects.select(F.col("_original").alias("original"), F.col("_problems").alias("problems"))


def audit_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table: ``tbl``, ``n_rows``."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("tbl"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def load_difference(before: DataFrame, after: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that differ in how often two loads hold them: ``columns``, ``n_before``, ``n_after``, ``change``.

    A row that only one load holds is ``added`` or ``removed``; one that both hold, but not as often, is
    ``repeated`` or ``thinned``. Values are compared with NULLs equal. Both loads are counted in one shuffle,
    combined on the map side, whatever the number of repeated rows.
    """
    columns = columns or before.columns
    sides = [
        df.select(*columns, F.lit(1 - side).cast("bigint").alias("n_before"), F.lit(side).cast("bigint").alias("n_after"))
        for side, df in enumerate((before, after))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*columns).agg(
        F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after")
    )
    change = (
        F.when(F.col("n_before") == 0, "added")
        .when(F.col("n_after") == 0, "removed")
        .when(F.col("n_after") > F.col("n_before"), "repeated")
        .otherwise("thinned")
    )
    return counted.filter(F.col("n_before") != F.col("n_after")).withColumn("change", change)
