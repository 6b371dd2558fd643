"""Row numbers by descending value, over slices of the order (see ``ordered``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import SLICE, row_number, sliced


def row_numbers(df: DataFrame, key: str, ranks: dict[str, str]) -> DataFrame:
    """Add ``alias: value`` row numbers, by descending value and then by the unique ``key``."""
    for alias, value in ranks.items():
        df = sliced_row_number(df, value, key, alias)
    return df


def by_descending(df: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns whose ascending order is that of ``value`` descending, NULLs last; and their names."""
    return df.withColumns({"_null": F.col(value).isNull(), "_value": -F.col(value)}), ["_null", "_value"]


def sliced_row_number(df: DataFrame, value: str, key: str, alias: str, *, by: str | None = None) -> DataFrame:
    """``row_number() over ([partition by by] order by value desc nulls last, key)``, unique ``key``, numeric value."""
    groups = [by] if by else []
    ordered, columns = by_descending(df, value)
    order = [*columns, key]
    return row_number(sliced(ordered, groups, order), groups, order, alias).drop(*columns, SLICE)
