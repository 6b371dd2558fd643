"""Raw records of the two external catalogues.

Catalogue A comes as pages holding a JSON array of nested records, catalogue B as pages holding one
JSON object keyed by app id. Both page sizes are fixed by their providers, so a page fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the providers' records.
_NAMED = "ARRAY<STRUCT<name: STRING>>"
RECORD_A = (
    "id BIGINT, name STRING, summary STRING, rating DOUBLE, rating_count INT, "
    f"first_release_date BIGINT, genres {_NAMED}, themes {_NAMED}, platforms {_NAMED}, "
    f"keywords {_NAMED}, game_modes {_NAMED}, involved_companies "
    "ARRAY<STRUCT<company: STRUCT<name: STRING>, developer: BOOLEAN, publisher: BOOLEAN>>"
)
# Numbers arrive as numbers or as text, tags as object or list: all are read as text and cast later.
INFO_B = (
    "name STRING, developer STRING, publisher STRING, score_rank STRING, owners STRING, "
    "average_forever STRING, average_2weeks STRING, median_forever STRING, median_2weeks STRING, "
    "ccu STRING, price STRING, initialprice STRING, discount STRING, positive STRING, "
    "negative STRING, tags STRING, languages STRING, genre STRING"
)


def read_catalog_a(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_A).option("multiLine", True).json(path)


def parse_catalog_a(messages: DataFrame, value: str = "value") -> DataFrame:
    return messages.select(F.from_json(value, RECORD_A).alias("r")).select("r.*")


def top_rated(records: DataFrame, total: int | None = None) -> DataFrame:
    """The rated records, or the ``total`` best of them; unrated ones never count."""
    rated = records.filter(F.col("rating").isNotNull())
    return rated if total is None else rated.orderBy(F.col("rating").desc(), F.col("id")).limit(total)


def read_catalog_b_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file named ``<page number>.json``."""
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int")
    return spark.read.text(path, wholetext=True).select(number.alias("page"), F.col("value").alias("body"))


def _apps() -> Column:
    return F.from_json("body", f"map<string, struct<{_struct_fields(INFO_B)}>>")


def explode_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Records of all readable pages (below ``max_pages``); the others are ``rejected_pages``."""
    if max_pages is not None:
        pages = pages.filter(F.col("page") < max_pages)
    return (
        pages.select("page", F.explode(_apps()).alias("appid", "info"))
        .select("page", F.col("appid").try_cast("bigint").alias("appid"), "info.*")
    )


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages that cannot be read, with their text; a page without records is none of them."""
    return pages.filter(_apps().isNull()).select("page", "body")


def _struct_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in ddl.split(", ")))
