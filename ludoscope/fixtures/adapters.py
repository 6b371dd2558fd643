"""Maps the test tables to the inputs of the operators; ``oracle`` holds the same rules in SQL.

Events become the four topics, parts with their order lines become the two catalogues.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import numbers
from ..operators import as_of, matching, ordered, overlaps, play_sessions, sketches, staging
from ..operators.live import live_state
from ..operators.normalize import review_score
from ..operators.unique import unique_events
from ..operators.windows import aggregate_windows
from ..plans import anomalies, marts
from ..plans.materialise import stored
from ..session import prepare, shared_folder
from ..sources import tables, topics
from ..sources.topics import RAW, TOPIC_SCHEMAS, TOPICS, is_malformed, parse_messages
from ..streaming import jobs, keyed_state, sinks

AS_OF = "2024-01-31 00:00:00"
DAY = "1 day"
DAY_SECONDS = 86_400
LIVE_DAYS = 7
# The test events are sparse, so their windows last a day and flags start at small counts.
VIRAL, SPIKE, VIRAL_WISHLIST, BOMB = 2, 2, 2, 2
# Event type of the test table that stands for each topic.
EVENT_TYPES = {
    "purchases": ("purchase",),
    "reviews": ("view",),
    "sessions": ("signup", "error"),
    "wishlist": ("click",),
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is looked up in the files once only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# -- topics ----------------------------------------------------------------------------------------


def topic_from_events(events: DataFrame, topic: str, since: str | None = None) -> DataFrame:
    """Events of one topic from the test table, batch or streaming.

    ``since`` reaches the scan; filters on the windows made from the events could not.
    """
    if since:
        events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    event_id, user_id = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    started = F.col("event_type") == "signup"
    head = {
        "event_id": event_id.cast("string"),
        "event_time": F.col("ts").cast("timestamp"),
        "user_id": user_id.cast("string"),
        "game_id": ((k * 17) % 1000).cast("int"),
    }
    if topic == "purchases":
        kind, body = F.lit("purchase"), {
            "price_usd": F.col("value").cast("decimal(18,2)").cast("double"),
            "discount_pct": F.when(event_id % 97 != 0, (event_id % 4 * 25).cast("int")),
            "payment_method": _numbered("method", event_id, 4),
            "country": _numbered("country", user_id, 10),
        }
    elif topic == "reviews":
        rating = (1 + event_id % 10).cast("int")
        kind, body = F.lit("review"), {
            "rating": rating,
            "recommended": rating >= 7,
            "hours_played": F.col("value"),
            "review_length_chars": F.floor("value").cast("int"),
            "language": _numbered("lang", user_id, 5),
            "helpful_votes": (event_id % 20).cast("int"),
        }
    elif topic == "sessions":
        beat = ~started & (event_id % 5 == 0)
        kind = F.when(started, "session_start").when(beat, "session_heartbeat").otherwise("session_end")
        head["session_id"] = F.concat(F.lit("s"), user_id.cast("string"))
        body = {
            "platform": F.when(started, _numbered("platform", user_id, 3)),
            "device": F.when(started, _numbered("device", user_id, 2)),
            "duration_seconds": F.when(~started & ~beat, F.floor(F.col("value") * 60).cast("int")),
        }
    else:
        kind, body = F.lit("wishlist_update"), {
            "action": F.when(event_id % 7 == 0, "removed").otherwise("added"),
            "source": _numbered("source", event_id, 3),
        }
    rows = events.filter(F.col("event_type").isin(*EVENT_TYPES[topic]))
    return rows.select(
        head["event_id"].alias("event_id"),
        kind.alias("event_type"),
        head["event_time"].alias("event_time"),
        *([head["session_id"].alias("session_id")] if "session_id" in head else []),
        head["user_id"].alias("user_id"),
        head["game_id"].alias("game_id"),
        *[value.alias(name) for name, value in body.items()],
    )


def _numbered(prefix: str, number: Column, modulus: int) -> Column:
    return F.concat(F.lit(f"{prefix}_"), (number % modulus).cast("string"))


def topic(spark: SparkSession, sf_dir: str, name: str, since: str | None = None) -> DataFrame:
    return topic_from_events(table(spark, sf_dir, "events"), name, since)


def messages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The topic as message values; every 101st is cut short and cannot be parsed."""
    rows = topic(spark, sf_dir, name)
    text = F.to_json(
        F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    )
    broken = F.col("event_id").cast("bigint") % 101 == 0
    return rows.select(
        "event_id", F.when(broken, F.substring(text, 1, 12)).otherwise(text).alias("value")
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream.

    The last letter is a pattern because the file source takes a lone file only from a pattern.
    All files form one batch: they are not in the order of their events, and a later batch would
    drop as late what an earlier one could not have seen.
    """
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("handler"),
        F.when(failed, 500).otherwise(200).alias("status"),
        (F.col("value") / 1000).alias("duration_s"),
    )


# -- windows ---------------------------------------------------------------------------------------


def days_before(days: int) -> str:
    return str(datetime.fromisoformat(AS_OF) - timedelta(days=days))


def windows(
    spark: SparkSession, sf_dir: str, name: str, window: str = DAY, days: int | None = None
) -> DataFrame:
    """Windows of a topic; with ``days`` only the whole days before ``AS_OF`` are read."""
    since = days_before(days) if days else None
    return aggregate_windows(topic(spark, sf_dir, name, since), name, window=window)


def staged_windows(
    spark: SparkSession, sf_dir: str, name: str, days: int | None = None
) -> DataFrame:
    rows = windows(spark, sf_dir, name, days=days)
    if name == "purchases":
        return staging.stage_purchase_windows(rows, viral_from=VIRAL, window_seconds=DAY_SECONDS)
    if name == "reviews":
        return staging.stage_review_windows(
            rows, bomb_from=BOMB, bomb_from_recommend=BOMB, window_seconds=DAY_SECONDS
        )
    if name == "sessions":
        return staging.stage_session_windows(rows, spike_from=SPIKE, window_seconds=DAY_SECONDS)
    return staging.stage_wishlist_windows(rows, viral_from=VIRAL_WISHLIST, window_seconds=DAY_SECONDS)


def all_staged_windows(
    spark: SparkSession, sf_dir: str, days: int | None = None
) -> list[DataFrame]:
    return [staged_windows(spark, sf_dir, name, days) for name in TOPICS]


# -- catalogues ------------------------------------------------------------------------------------


def catalog_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue B as its stored table."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.count(F.lit(1)).cast("int").alias("ccu"),
            F.count_if(F.col("l_returnflag") != "R").cast("int").alias("positive"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("negative"),
        )
    )
    key, size = F.col("p_partkey"), F.col("p_size")
    factors = F.array(*[F.lit(f).cast("bigint") for f in (0, 1, 10, 1000, 100_000)])
    owners = F.coalesce("quantity", F.lit(0)).cast("bigint") * F.get(factors, (key % 5).cast("int"))
    price = (F.col("p_retailprice") - 900).cast("decimal(10,2)").cast("double")
    tags = F.concat_ws(
        ", ",
        "p_type",
        "p_brand",
        F.concat(F.lit("size "), size.cast("string")),
        F.split_part("p_name", F.lit(" "), F.lit(1)),
    )
    rows = table(spark, sf_dir, "part").join(sold, "p_partkey", "left")
    rows = rows.fillna(0, ["ccu", "positive", "negative"])
    return rows.select(
        key.cast("int").alias("appid"),
        F.concat_ws(" ", "p_name", key.cast("string")).alias("name"),
        F.concat(F.lit("Studio "), (key % 40).cast("string")).alias("developer"),
        F.col("p_brand").alias("publisher"),
        F.lit("").alias("score_rank"),
        F.concat_ws(" .. ", owners.cast("string"), owners.cast("string")).alias("owners_range"),
        owners.alias("owners_estimate"),
        (size * 37).alias("average_forever"),
        (size * 7).alias("average_2weeks"),
        (size * 29).alias("median_forever"),
        (size * 3).alias("median_2weeks"),
        "ccu",
        price.alias("price_usd"),
        price.alias("initialprice_usd"),
        (key % 3 * 25).cast("int").alias("discount_pct"),
        "positive",
        "negative",
        review_score(F.col("positive"), F.col("negative")).alias("review_score"),
        tags.alias("tags"),
        F.lit("English").alias("languages"),
        F.col("p_type").alias("genre"),
    )


def catalog_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue A as its stored table.

    A third of the titles are those of catalogue B, and some of them occur twice; the other records
    are remasters, which catalogue B does not list.
    """
    key, size = F.col("p_partkey"), F.col("p_size")
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    edition = F.when(key % 3 != 0, "remastered")
    title = F.concat_ws(" ", "p_name", key.cast("string"), edition)
    rows = table(spark, sf_dir, "part").select("*", F.explode(copies).alias("copy"))
    return rows.select(
        (key * 10 + F.col("copy")).cast("int").alias("igdb_id"),
        F.concat(F.lit("  "), F.upper(title), F.lit(" ")).alias("name"),
        F.concat(F.lit("About "), "p_name").alias("summary"),
        F.when(key % 7 != 0, (key % 100).cast("double") + 0.5).alias("rating"),
        (key % 500 + F.col("copy")).cast("int").alias("rating_count"),
        F.date_add(F.lit("2000-01-01").cast("date"), (key % 9000).cast("int")).alias("release_date"),
        F.concat_ws(", ", "p_type", "p_brand").alias("genres"),
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("themes"),
        F.concat(F.lit("size "), size.cast("string")).alias("platforms"),
        F.col("p_type").alias("keywords"),
        F.lit("Single player").alias("game_modes"),
        F.when(key % 2 == 0, "")
        .otherwise(F.concat(F.lit("Team "), (key % 30).cast("string"), F.lit(", Inc.")))
        .alias("developer"),
        F.when(key % 2 == 0, "").otherwise(F.col("p_brand")).alias("publisher"),
    )


def games(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return marts.mart_games(
        staging.stage_catalog_b(catalog_b(spark, sf_dir)),
        staging.stage_catalog_a(catalog_a(spark, sf_dir)),
        **options,
    )


_warehouse: dict[tuple[str, str, str], str] = {}


def warehouse(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that is built from ``sf_dir`` once in an application and read back from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _warehouse:
        path = shared_folder(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _warehouse[key] = path
    return spark.read.parquet(_warehouse[key])


def raw_records_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested catalogue A records as JSON text in ``value``."""

    def named(*names: Column) -> Column:
        return F.array(*[F.struct(n.alias("name")) for n in names])

    def company(name: Column, developer: bool, publisher: bool) -> Column:
        return F.struct(
            F.struct(name.alias("name")).alias("company"),
            F.lit(developer).alias("developer"),
            F.lit(publisher).alias("publisher"),
        )

    key = F.col("p_partkey")
    record = F.struct(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.when(key % 7 != 0, (key % 100).cast("double") + 0.5).alias("rating"),
        (key % 500).cast("int").alias("rating_count"),
        F.when(key % 11 != 0, key * 86_400 + 3_600).alias("first_release_date"),
        named(F.col("p_type"), F.lit(""), F.col("p_brand")).alias("genres"),
        F.when(key % 5 != 0, named(F.col("p_brand"))).alias("themes"),
        named(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("platforms"),
        F.array(
            company(F.col("p_brand"), True, False),
            company(F.lit("House"), True, True),
            company(F.lit(""), False, True),
        ).alias("involved_companies"),
    )
    return table(spark, sf_dir, "part").select(F.to_json(record).alias("value"))


def raw_pages_b(spark: SparkSession, sf_dir: str, page_size: int = 100) -> DataFrame:
    """Catalogue B pages: JSON objects of at most ``page_size`` records keyed by app id."""
    key = F.col("p_partkey")
    cents = F.round((F.col("p_retailprice") - 900) * 100).cast("bigint").cast("string")
    low = key * 1000
    info = F.struct(
        F.col("p_name").alias("name"),
        F.concat(F.lit("Studio "), (key % 40).cast("string")).alias("developer"),
        F.col("p_brand").alias("publisher"),
        F.concat_ws(" .. ", F.format_number(low, 0), F.format_number(low + 3000, 0)).alias("owners"),
        (F.col("p_size") * 37).alias("average_forever"),
        F.when(key % 13 == 0, "n/a").otherwise(cents).alias("price"),
        cents.alias("initialprice"),
        (key % 60).alias("positive"),
        F.when(key % 9 != 0, key % 7).alias("negative"),
        F.map_from_arrays(
            F.array("p_type", "p_brand"), F.array(F.lit(2), F.lit(1))
        ).alias("tags"),
        F.col("p_type").alias("genre"),
    )
    entry = F.struct(key.cast("string").alias("key"), info.alias("value"))
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.call_function("div", key, F.lit(page_size)).cast("int").alias("page"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("body"))
    )


def damaged_pages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, every fifth from page 2 on cut short in transit."""
    cut = F.col("page") % 5 == 2
    return raw_pages_b(spark, sf_dir, 10).select(
        "page", F.when(cut, F.concat(F.lit("cut "), "page")).otherwise(F.col("body")).alias("body")
    )


def unreadable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the purchase messages that cannot be parsed."""
    parsed = parse_messages(messages(spark, sf_dir, "purchases"), "purchases", keep_raw=True)
    return parsed.filter(is_malformed(parsed)).select(F.col(RAW).alias("message"))


# -- stored tables and streams ---------------------------------------------------------------------


def update_mode_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase windows as a stream in update mode would emit them over three batches."""
    arrived = (F.col("event_id").cast("bigint") % 3).alias("batch_id")
    rows = topic(spark, sf_dir, "purchases").select("*", arrived)
    per_batch = rows.groupBy(F.window("event_time", DAY).alias("span"), "game_id", "batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(numbers.net_hundredths(F.col("price_usd"), F.col("discount_pct"))).alias("hundredths"),
    )
    so_far = Window.partitionBy("span", "game_id").orderBy("batch_id")
    return per_batch.select(
        F.col("span.start").alias("window_start"),
        "game_id",
        "batch_id",
        F.sum("n").over(so_far).alias("num_purchases"),
        (F.sum("hundredths").over(so_far) / F.lit(100)).cast("double").alias("revenue_net_usd"),
    )


def stream_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose state is spread over its cores."""
    session = prepare(spark.newSession())
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def run_aggregate_stream(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Stream the events file through a topic's standing query; returns the output root."""
    session = stream_session(spark)
    root, checkpoints = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    events = topic_from_events(event_stream(session, sf_dir), name)
    query = jobs.start_aggregate(
        events, name, root, checkpoints, window=DAY, trigger={"availableNow": True}
    )
    query.awaitTermination()
    return root


LATE_BEFORE = "2024-01-10"


def late_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A topic's events with ``drop``, the delivery they come in: three periods, then some events of the first."""
    rows = topic(spark, sf_dir, name)
    early = F.col("event_time") < F.lit(LATE_BEFORE).cast("timestamp")
    late = early & (F.col("event_id").cast("bigint") % 50 == 0)
    later = F.col("event_time") < F.lit("2024-01-20").cast("timestamp")
    return rows.withColumn("drop", F.when(late, 3).when(early, 0).when(later, 1).otherwise(2))


FILES = 2  # of each delivery


def delivered(spark: SparkSession, rows: DataFrame, drops: int = 4) -> tuple[str, StructType]:
    """A folder with the rows of each ``drop`` in FILES files, one delivery after the other; and their schema."""
    source = shared_folder(spark, "drops")
    for drop in range(drops):
        part = rows.filter(F.col("drop") == drop).drop("drop")
        part.repartitionByRange(FILES, "event_id").write.mode("append").parquet(source)
    return source, rows.drop("drop").schema


def delivery_stream(session: SparkSession, source: str, schema: StructType) -> DataFrame:
    return session.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(source)


def run_deliveries(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A topic's standing query over four deliveries in four micro-batches; returns the output root.

    The last delivery brings events of windows that are long closed.
    """
    session = stream_session(spark)
    root, checkpoints = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    events = delivery_stream(session, *delivered(spark, late_events(spark, sf_dir, name)))
    query = jobs.start_aggregate(
        events, name, root, checkpoints, window=DAY, trigger={"availableNow": True}
    )
    query.awaitTermination()
    return root


def streamed_deliveries(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sinks.read_history(spark, run_deliveries(spark, sf_dir, name), name)


def expiring_live(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Live entries as keyed state with timers, from the history that four deliveries left."""
    root, checkpoints = run_deliveries(spark, sf_dir, name), shared_folder(spark, "progress")
    session = stream_session(spark)
    for key, value in keyed_state.STATE_STORE.items():
        session.conf.set(key, value)
    query = keyed_state.start_expiring(
        session, name, root, checkpoints, ttl_seconds=LIVE_DAYS * DAY_SECONDS, window_seconds=DAY_SECONDS,
        trigger={"availableNow": True}, maxFilesPerTrigger="60",
    )
    query.awaitTermination()
    entries = keyed_state.read_expiring(spark, root, name).withColumnRenamed("closes", "updated_at")
    return entries.withColumn("topic", F.lit(name))


def with_flush(rows: DataFrame) -> DataFrame:
    """One more delivery, of an event far ahead, after which the watermark has passed all others."""
    schema = rows.schema
    fixed = {"event_id": "flush", "event_time": datetime(2024, 6, 1, tzinfo=timezone.utc), "user_id": "flush", "drop": 4}
    fixed |= {"game_id": -1, "event_type": "flush"}
    last = rows.sparkSession.createDataFrame([tuple(fixed.get(f.name) for f in schema)], StructType([
        StructField(f.name, f.dataType) for f in schema
    ]))
    return rows.unionByName(last)


def _collected(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What a stream gives out in append mode, batch by batch, stored and read back."""
    target, checkpoints = shared_folder(spark, name), shared_folder(spark, "progress")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoints)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch_id")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play sessions of a player over the deliveries of the sessions topic."""
    rows = with_flush(late_events(spark, sf_dir, "sessions"))
    events = delivery_stream(stream_session(spark), *delivered(spark, rows, 5))
    found = play_sessions.play_sessions(events, gap_seconds=DAY_SECONDS, by=("user_id",), watermark="10 seconds")
    return _collected(found, spark, "sessions").filter("user_id <> 'flush'")


def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the player's reviews of the following week, over the deliveries of both topics."""
    session = stream_session(spark)
    sides = [
        delivery_stream(session, *delivered(spark, with_flush(late_events(spark, sf_dir, name)), 5))
        for name in ("purchases", "reviews")
    ]
    found = matching.followed_by(*sides, by=("user_id",), watermarks=("10 seconds", "10 seconds"))
    return _collected(_matched(found), spark, "matches").filter("user_id <> 'flush'")


def _matched(found: DataFrame) -> DataFrame:
    """The columns of a match that the registered queries give."""
    return found.select(
        F.col("purchase_event_id").alias("event_id"),
        F.col("purchase_event_time").alias("event_time"),
        F.col("purchase_user_id").alias("user_id"),
        F.col("review_event_id").alias("review_id"),
        F.col("review_event_time").alias("review_time"),
        F.col("review_rating").alias("rating"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(matching.followed_by(topic(spark, sf_dir, "purchases"), topic(spark, sf_dir, "reviews"), by=("user_id",)))


def repeated_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A topic's deliveries in which every tenth event comes twice, and once more in the next delivery."""
    rows = late_events(spark, sf_dir, name)
    again = F.col("event_id").cast("bigint") % 10 == 0
    times = F.when(again, F.array(F.lit(0), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("later", F.explode(times)).withColumn("drop", F.least(F.col("drop") + F.col("later"), F.lit(3))).drop("later")


def streamed_unique(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session = stream_session(spark)
    root, checkpoints = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    events = delivery_stream(session, *delivered(spark, repeated_events(spark, sf_dir, name)))
    query = jobs.start_raw(events, name, root, checkpoints, trigger={"availableNow": True}, unique_within="10 seconds")
    query.awaitTermination()
    return sinks.read_raw(spark, root, name).drop("date")


def unique(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return unique_events(repeated_events(spark, sf_dir, name).drop("drop"))


RAW_SINCE = "2024-01-10"


def raw_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase messages, some dated years ahead and some unreadable, copied and read from a day on."""
    session = stream_session(spark)
    source, root, checkpoints = (shared_folder(spark, p) for p in ("drops", "stream", "progress"))
    rows = messages(spark, sf_dir, "purchases")
    ahead = F.col("event_id").cast("bigint") % 103 == 0
    rows.select(F.when(ahead, F.replace("value", F.lit('"event_time":"2024'), F.lit('"event_time":"2031'))).otherwise(F.col("value"))).write.text(source)
    events = topics.read_topic(session, "purchases", path=source)
    jobs.start_raw(events, "purchases", root, checkpoints, trigger={"availableNow": True}).awaitTermination()
    kinds = [
        sinks.read_raw(spark, root, "purchases", kind, since=RAW_SINCE).select(
            "event_id", "date", F.lit(kind).alias("status"), (F.col(RAW) if kind == "reject" else F.lit(None).cast("string")).alias("message")
        )
        for kind in ("good", "reject")
    ]
    return kinds[0].unionByName(kinds[1])


def odd_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of which some cost a billionth of a dollar, two billion, or nothing that is an amount."""
    number, price = F.col("event_id").cast("bigint") % 13, F.col("price_usd")
    odd = F.when(number == 0, 1e-9).when(number == 1, 2e9).when(number == 2, float("nan")).when(number == 3, 1e18)
    return topic(spark, sf_dir, "purchases").withColumn("price_usd", odd.otherwise(price))


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes: a review stands for a new list price of its game, every eleventh for none."""
    rows = topic(spark, sf_dir, "reviews")
    number = F.col("event_id").cast("bigint")
    return rows.select(
        "game_id",
        F.col("event_time").alias("since"),
        number.alias("change"),
        F.when(number % 11 != 0, number % 60).alias("list_price"),
    )


def price_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list price at each purchase."""
    found = as_of.in_force(
        topic(spark, sf_dir, "purchases"), price_list(spark, sf_dir), ["game_id"], "event_time", ["change", "list_price"],
        state_time="since", version="change",
    )
    return found.select("event_id", "game_id", "change", "list_price")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns of games: of hours, of days, and some of most of the month."""
    number = F.col("event_id").cast("bigint")
    hours = F.when(number % 97 == 0, 500).when(number % 7 == 0, 50).otherwise(number % 5)
    return topic(spark, sf_dir, "wishlist").select(
        F.col("event_id").alias("campaign"), "game_id", F.col("event_time").alias("starts"),
        (F.col("event_time") + F.make_dt_interval(hours=hours.cast("int"))).alias("ends"),
    )


def campaign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps.at_moments(
        topic(spark, sf_dir, "purchases"), campaigns(spark, sf_dir), ["game_id"], "event_time", ("starts", "ends")
    )
    return found.select("left.event_id", "left.game_id", "right.campaign")


def campaign_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = campaigns(spark, sf_dir)
    found = overlaps.overlapping(every, every, ["game_id"], ("starts", "ends"), ("starts", "ends"))
    one, other = F.col("left.campaign"), F.col("right.campaign")
    return found.filter(one < other).select(one.alias("campaign"), other.alias("other"))


def purchase_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since a game's purchase before."""
    by, order = ["game_id"], ["event_time", "event_id"]
    cut = ordered.sliced(topic(spark, sf_dir, "purchases").select(*by, *order), by, order)
    found = ordered.previous(cut, by, order, "event_time", "before")
    seconds = F.unix_seconds("event_time") - F.unix_seconds("before")
    return found.select("event_id", "game_id", seconds.alias("seconds_since"))


def owner_deciles(games: DataFrame) -> DataFrame:
    """Tenth of the games, by falling owners."""
    rows = games.select("steam_app_id", "owners_estimate", (-F.col("owners_estimate")).alias("falling"))
    order = ["falling", "steam_app_id"]
    return ordered.ntile(ordered.sliced(rows, [], order), [], order, 10, "decile").select("steam_app_id", "owners_estimate", "decile")


def load_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two loads of catalogue B: rows gone, new, changed, and held twice."""
    columns = ["appid", "name", "publisher", "ccu"]
    rows, key = catalog_b(spark, sf_dir).select(*columns), F.col("appid")
    before = rows.filter(key % 19 != 0).withColumn("publisher", F.when(key % 5 != 0, F.col("publisher")))
    changed = rows.filter(key % 23 != 0).withColumn("publisher", F.when(key % 5 != 0, F.col("publisher")))
    after = changed.withColumn("ccu", F.when(key % 29 == 0, F.lit(-1)).otherwise(F.col("ccu")))
    return tables.load_difference(before, after.unionByName(after.filter(key % 31 == 0)), columns)


def day_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of days out of stored sketches of minutes."""
    minutes = stored(sketches.latency_sketches(request_log(spark, sf_dir)), "latency-sketches")
    return sketches.latency_of(sketches.merged_latency(minutes))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of each game and week out of stored sketches of hours."""
    hours = stored(sketches.user_sketches(topic(spark, sf_dir, "sessions"), "game_id"), "user-sketches")
    return sketches.users_of(sketches.merged_users(hours, "game_id", span="week"), "game_id")


def streamed_windows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sinks.read_history(spark, run_aggregate_stream(spark, sf_dir, name), name)


def streamed_live(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = run_aggregate_stream(spark, sf_dir, name)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    entries = sinks.read_live(spark, root, name, as_of=now)
    return live_state({name: entries}, as_of=now).drop("updated_at")


def streamed_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root, checkpoints = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    events = topic_from_events(event_stream(stream_session(spark), sf_dir), name)
    jobs.start_raw(events, name, root, checkpoints, trigger={"availableNow": True}).awaitTermination()
    return sinks.read_raw(spark, root, name).drop("date")


def live_windows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Day windows of every topic, updated last when the window closed."""
    closed = F.col("window_start") + F.make_dt_interval(F.lit(1))
    return {t: windows(spark, sf_dir, t, days=LIVE_DAYS + 1).withColumn("updated_at", closed) for t in TOPICS}


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live state over the last week of the test events."""
    return live_state(live_windows(spark, sf_dir), as_of=AS_OF, ttl_seconds=LIVE_DAYS * DAY_SECONDS)


def loaded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase windows arrive in two drops, with integer times and some unusable ids."""
    source, target, progress = (shared_folder(spark, p) for p in ("drops", "loaded", "progress"))
    bad = F.col("game_id") % 10 == 3
    rows = windows(spark, sf_dir, "purchases").select(
        (F.unix_micros("window_start") * 1000).alias("window_start"),
        F.when(bad, "unknown").otherwise(F.col("game_id").cast("string")).alias("game_id"),
        "num_purchases",
        "revenue_net_usd",
    )
    half = F.unix_micros(F.lit("2024-01-16").cast("timestamp")) * 1000
    schema = "window_start BIGINT, game_id STRING, num_purchases BIGINT, revenue_net_usd DOUBLE"
    for drop, part in enumerate((F.col("window_start") < half, F.col("window_start") >= half)):
        rows.filter(part).write.parquet(f"{source}/drop={drop}")
        tables.load_incremental(
            stream_session(spark),
            source,
            schema,
            target,
            tables.WINDOW_TABLES["purchases"],
            progress,
            prepare=tables.nanos_to_timestamp,
            required=("window_start", "game_id"),
            as_of=AS_OF,
        )
    return tables.read_loaded(spark, target)


def loaded_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A topic's events from raw files; identifiers were written as text."""
    source, target, progress = (shared_folder(spark, p) for p in ("drops", "loaded", "progress"))
    rows = topic(spark, sf_dir, name)
    rows = rows.withColumn("game_id", F.col("game_id").cast("string"))
    rows.write.parquet(source)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    tables.load_incremental(
        stream_session(spark),
        source,
        ddl,
        target,
        TOPIC_SCHEMAS[name],
        progress,
        required=("event_id", "event_time", "game_id"),
        as_of=AS_OF,
    )
    return tables.read_loaded(spark, target)


def refreshed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of catalogue B are stored, the second one is loaded."""
    root, target = shared_folder(spark, "dated"), shared_folder(spark, "table")
    today = catalog_b(spark, sf_dir)
    tables.write_dated(today.withColumn("ccu", F.lit(0)), root, "steamspy_games", "2024-01-30")
    tables.write_dated(today, root, "steamspy_games", "2024-01-31")
    return tables.full_refresh(
        spark,
        root,
        "steamspy_games",
        "2024-01-31",
        tables.CATALOG_B_TABLE,
        target,
        required=("appid",),
        as_of=AS_OF,
    )


def rewritten_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day that is written twice keeps the second content, and the other day stays."""
    root = shared_folder(spark, "dated")
    a = catalog_a(spark, sf_dir)
    path = tables.write_dated(a, root, "igdb_games", "2024-01-30")
    tables.write_dated(a.withColumn("summary", F.lit("draft")), root, "igdb_games", "2024-01-31")
    tables.write_dated(a, root, "igdb_games", "2024-01-31")
    return spark.read.parquet(path)


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as text columns, some of them unusable: the rejects of the typed load."""
    rows = topic(spark, sf_dir, "purchases")
    number = F.col("event_id").cast("bigint")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    broken = text.withColumn(
        "game_id", F.when(number % 89 == 0, "??").otherwise(F.col("game_id"))
    ).withColumn("price_usd", F.when(number % 83 == 0, "free").otherwise(F.col("price_usd")))
    _, rejects = tables.split_rejects(
        broken, TOPIC_SCHEMAS["purchases"], ("event_id", "event_time", "game_id")
    )
    return rejects.select("event_id", "game_id", "price_usd", F.col("_problems").alias("problems"))


def stored_findings(spark: SparkSession, sf_dir: str, findings: DataFrame) -> DataFrame:
    return anomalies.replace_findings(findings, shared_folder(spark, "findings"), AS_OF)
