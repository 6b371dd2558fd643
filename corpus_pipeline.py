"""From raw documents to a training mix, in five stages over the operators of ``ludoscope.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and reread as the next one's documents. Labels and benchmark come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludoscope.llm.common import prepare, stored, table
from ludoscope.llm.decontamination import clean
from ludoscope.llm.line_quality import with_quality
from ludoscope.llm.mixing import mixed
from ludoscope.llm.near_duplicates import one_of_each_group
from ludoscope.llm.queries import GOOD_FROM
from ludoscope.llm.secret_scan import find_secrets

MASK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is not rejected."""
    prepare(spark)
    scored, score = with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(score) >= GOOD_FROM).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles."""
    prepare(spark)
    return one_of_each_group(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    prepare(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths counted anew."""
    prepare(spark)
    found, spans = find_secrets(docs, mask=MASK)
    n_chars = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how many times."""
    prepare(spark)
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
]

#: The quality classifier cannot be expressed in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
