"""Totals of all levels at once, each told from the others and from NULLs in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _told(grouped, dimensions: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    """``all_<dimension>`` is true where the row is a total over that dimension; ``grouping_id`` has a bit for each."""
    over = [(F.grouping(d) == 1).alias(f"all_{d}") for d in dimensions]
    totals = grouped.agg(F.grouping_id(*dimensions).cast("int").alias("grouping_id"), *over, *[m.alias(n) for n, m in measures.items()])
    return totals.select(*dimensions, *[f"all_{d}" for d in dimensions], "grouping_id", *measures)


def rolled_up(df: DataFrame, *dimensions: str, **measures: Column) -> DataFrame:
    """Totals along a hierarchy: by all dimensions, by all but the last, ..., and over everything.

    A NULL dimension is a value of its own where ``all_<dimension>`` is false. Rows are spread over the levels
    before they are combined on the map side, so there is one shuffle, of combined rows.
    """
    return _told(df.rollup(*dimensions), dimensions, measures)


def all_subtotals(df: DataFrame, *dimensions: str, **measures: Column) -> DataFrame:
    """As ``rolled_up``, for every subset of the dimensions."""
    return _told(df.cube(*dimensions), dimensions, measures)
