"""Where results live: staging as views, marts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_folder


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def as_table(df: DataFrame, root: str, name: str, *, cluster_by: str | None = None) -> DataFrame:
    """Write a mart once and read it back, so that its readers share the work and its lineage ends.

    With ``cluster_by`` the files hold ranges of that column, and a lookup by it opens few of them.
    The stored table is also visible to SQL under ``name``.
    """
    path = f"{root}/{name}"
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.mode("overwrite").parquet(path)
    return as_view(df.sparkSession.read.schema(df.schema).parquet(path), name)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several branches of a plan need the same rows: it is computed once, the plan behind
    it is cut off, and a lost executor costs a file read instead of the whole lineage.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
