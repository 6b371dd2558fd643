"""The four event topics: their schemas, and the parse shared by every transport."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names and types of the JSON messages.
TOPIC_SCHEMAS = {
    "purchases": (
        "event_id STRING NOT NULL, event_type STRING NOT NULL, event_time TIMESTAMP NOT NULL, "
        "user_id STRING NOT NULL, game_id INT NOT NULL, price_usd DOUBLE NOT NULL, "
        "discount_pct INT, payment_method STRING, country STRING"
    ),
    "reviews": (
        "event_id STRING NOT NULL, event_type STRING NOT NULL, event_time TIMESTAMP NOT NULL, "
        "user_id STRING NOT NULL, game_id INT NOT NULL, rating INT NOT NULL, "
        "recommended BOOLEAN NOT NULL, hours_played DOUBLE, review_length_chars INT, "
        "language STRING, helpful_votes INT"
    ),
    "sessions": (
        "event_id STRING NOT NULL, event_type STRING NOT NULL, event_time TIMESTAMP NOT NULL, "
        "session_id STRING NOT NULL, user_id STRING NOT NULL, game_id INT NOT NULL, "
        "platform STRING, device STRING, duration_seconds INT"
    ),
    "wishlist": (
        "event_id STRING NOT NULL, event_type STRING NOT NULL, event_time TIMESTAMP NOT NULL, "
        "user_id STRING NOT NULL, game_id INT NOT NULL, action STRING NOT NULL, source STRING"
    ),
}
TOPICS = tuple(TOPIC_SCHEMAS)


def check_topic(topic: str) -> str:
    if topic not in TOPIC_SCHEMAS:
        raise ValueError(f"unknown topic {topic!r}, expected one of {', '.join(TOPICS)}")
    return topic


RAW = "_raw"  # text of a message that cannot be read


def parse_messages(
    messages: DataFrame, topic: str, value: str = "value", *, keep_raw: bool = False
) -> DataFrame:
    """JSON text in ``value`` -> typed columns; a malformed message becomes a row of NULLs.

    ``keep_raw`` adds the text of malformed messages as ``_raw``.
    """
    message = F.col(value).cast("string")
    parsed = F.from_json(message, TOPIC_SCHEMAS[check_topic(topic)])
    rows = messages.select(parsed.alias("data"), message.alias(RAW)).select("data.*", RAW)
    if not keep_raw:
        return rows.drop(RAW)
    return rows.withColumn(RAW, F.when(is_malformed(rows), F.col(RAW)))


def is_malformed(parsed: DataFrame) -> Column:
    """True for the all-NULL rows that unreadable messages leave behind."""
    return reduce(and_, [F.col(c).isNull() for c in parsed.columns if c != RAW])


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = is_malformed(parsed)
    return parsed.filter(~bad), parsed.filter(bad)


def read_topic(
    spark: SparkSession,
    topic: str,
    *,
    bootstrap: str | None = None,
    path: str | None = None,
    starting_offsets: str = "latest",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming rows of one topic, from a message broker or from a folder of JSON-lines files.

    ``options`` go to the reader: ``maxOffsetsPerTrigger`` and ``minPartitions`` bound and spread
    the load of a broker's few partitions, ``maxFilesPerTrigger`` does it for files. Messages that
    cannot be read keep their text in ``_raw``.
    """
    check_topic(topic)
    if bootstrap:
        raw = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .options(**(options or {}))
            .load()
        )
    elif path:
        raw = spark.readStream.format("text").options(**(options or {})).load(path)
    else:
        raise ValueError("name either bootstrap servers or a folder")
    return parse_messages(raw, topic, keep_raw=True)
