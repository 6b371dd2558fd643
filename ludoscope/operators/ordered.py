"""Columns that depend on the order of rows, without sorting a whole table, or a whole group, in one task.

``sliced`` cuts the order into ranges of similar size and stores them, so a group that holds a large part of
all rows lies in many slices. Inside a slice ordinary windows do the work; what a slice needs of the
slices before or after it is one value, or a few rows, and concerns one group only: the first group of a
slice may go on from the slice before, its last one into the next. These borders, a row for each slice,
are broadcast; there are as many slices as shuffle partitions at most.

``by`` names the columns of the groups and ``order`` those of the order within them. Both ascend, NULLs come
first, and together they should be unique, else the order of equal rows is any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import stored

SLICE = "_slice"


def sliced(df: DataFrame, by: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` with the number of each row's slice, stored; slices follow each other in the order."""
    places = [F.col(c) for c in (*by, *order)]
    ranges = df.repartitionByRange(slices, *places) if slices else df.repartitionByRange(*places)
    return stored(ranges.withColumn(SLICE, F.spark_partition_id()), "slices")


def _group(by: list[str]) -> Column:
    return F.struct(*([F.col(c).alias(f"g{k}") for k, c in enumerate(by)] or [F.lit(0).alias("g0")]))


def _place(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])


def _inside(by: list[str], order: list[str], backwards: bool = False):
    columns = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    return Window.partitionBy(SLICE, *by).orderBy(*columns)


def running_sum(rows: DataFrame, by: list[str], order: list[str], amounts: dict[str, str], *, backwards: bool = False) -> DataFrame:
    """Add ``alias: column`` sums over the group's rows up to each row, from its first, or from its last backwards.

    ``rows`` come from ``sliced``. The amounts are numbers without NULLs.
    """
    per_group = rows.groupBy(SLICE, _group(by).alias("group")).agg(*[F.sum(c).alias(a) for a, c in amounts.items()])
    carried = _carried(per_group, list(amounts), lambda a, before: F.sum(a).over(before), backwards)
    whole = _inside(by, order, backwards).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({a: F.sum(c).over(whole) for a, c in amounts.items()})
    return _with_carried(summed, by, carried, {a: lambda inside, carry: inside + F.coalesce(carry, F.lit(0)) for a in amounts})


def last_known(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Add ``alias: column``, of each the last value that is not NULL, of the group's rows up to each row."""
    known = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(_place(order).alias("place"), F.col(c).alias("value")))).alias(a)
        for a, c in values.items()
    ]
    per_group = rows.groupBy(SLICE, _group(by).alias("group")).agg(*known)
    carried = _carried(per_group, list(values), lambda a, before: F.last(a, ignorenulls=True).over(before), False)
    upto = _inside(by, order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({a: F.last(c, ignorenulls=True).over(upto) for a, c in values.items()})
    return _with_carried(found, by, carried, {a: lambda inside, carry: F.coalesce(inside, carry["value"]) for a in values})


def _carried(per_group: DataFrame, names: list[str], over, backwards: bool) -> DataFrame:
    """(slice, group, names) that the slices before hand to the group a slice begins with.

    Backwards, that the slices behind hand to the group a slice ends with.
    """
    inner, outer = (F.min, F.max) if not backwards else (F.max, F.min)
    borders = per_group.groupBy(SLICE).agg(
        inner("group").alias("from_before"), outer(F.struct("group", *names)).alias("to_next")
    )
    asks = borders.select(SLICE, F.col("from_before").alias("group"), F.lit(0).alias("gives"), *[
        F.lit(None).cast(per_group.schema[n].dataType).alias(n) for n in names
    ])
    gives = borders.select(SLICE, "to_next.group", F.lit(1).alias("gives"), *[f"to_next.{n}" for n in names])
    place = F.col(SLICE).desc() if backwards else F.col(SLICE).asc()
    # Rows of borders only: two for each slice.
    before = Window.partitionBy("group").orderBy(place, "gives").rowsBetween(Window.unboundedPreceding, -1)
    handed = asks.unionByName(gives).select(SLICE, "group", "gives", *[over(n, before).alias(n) for n in names])
    return handed.filter("gives = 0").drop("gives")


def _with_carried(rows: DataFrame, by: list[str], carried: DataFrame, combine: dict) -> DataFrame:
    names = {n: f"_carried_{k}" for k, n in enumerate(combine)}
    side = carried.select(F.col(SLICE).alias("_s"), F.col("group").alias("_g"), *[F.col(n).alias(c) for n, c in names.items()])
    same = (F.col(SLICE) == F.col("_s")) & _group(by).eqNullSafe(F.col("_g"))
    joined = rows.join(F.broadcast(side), same, "left")
    return joined.withColumns({n: combine[n](F.col(n), F.col(c)) for n, c in names.items()}).drop("_s", "_g", *names.values())


def neighbours(
    rows: DataFrame, by: list[str], order: list[str], value: Column, alias: str, *, count: int = 1, before: bool = False
) -> DataFrame:
    """Add an array of ``value`` of the next ``count`` rows of the group, the nearest first, or of those before.

    Fewer at the end of a group. A NULL value is an element like others.
    """
    one = F.struct(value.alias("value"))
    whole = [F.col(c).desc() if before else F.col(c).asc() for c in (*by, *order)]
    first = Window.partitionBy(SLICE).orderBy(*whole)
    # The ends of the slices that neighbours in other slices look for.
    ends = (
        rows.select(SLICE, _group(by).alias("group"), one.alias("one"), F.row_number().over(first).alias("number"))
        .filter(F.col("number") <= count)
        .groupBy(SLICE)
        .agg(F.array_sort(F.collect_list(F.struct("number", "group", "one"))).alias("ends"))
    )
    outer = (F.min if before else F.max)(_group(by))
    borders = rows.groupBy(SLICE).agg(outer.alias("group")).join(ends, SLICE)
    following = Window.orderBy(F.col(SLICE).desc() if before else F.col(SLICE).asc()).rowsBetween(1, count)
    of_group = F.filter(F.flatten(F.collect_list("ends").over(following)), lambda e: e["group"].eqNullSafe(F.col("group")))
    handed = borders.withColumn("handed", F.transform(F.slice(of_group, 1, count), lambda e: e["one"])).select(
        F.col(SLICE).alias("_s"), F.col("group").alias("_g"), "handed"
    )
    near = F.collect_list(one).over(_inside(by, order, before).rowsBetween(1, count))
    joined = rows.withColumn(alias, near).join(
        F.broadcast(handed), (F.col(SLICE) == F.col("_s")) & _group(by).eqNullSafe(F.col("_g")), "left"
    )
    none = F.slice(F.col(alias), 1, 0)
    found = F.slice(F.concat(F.col(alias), F.coalesce("handed", none)), 1, count)
    return joined.withColumn(alias, F.transform(found, lambda e: e["value"])).drop("_s", "_g", "handed")


def previous(rows: DataFrame, by: list[str], order: list[str], column: str, alias: str) -> DataFrame:
    """``lag(column)``: the value in the row before, NULL in a group's first."""
    return neighbours(rows, by, order, F.col(column), alias, before=True).withColumn(alias, F.get(alias, F.lit(0)))


def following(rows: DataFrame, by: list[str], order: list[str], column: str, alias: str) -> DataFrame:
    """``lead(column)``: the value in the next row, NULL in a group's last."""
    return neighbours(rows, by, order, F.col(column), alias).withColumn(alias, F.get(alias, F.lit(0)))


def row_number(rows: DataFrame, by: list[str], order: list[str], alias: str) -> DataFrame:
    ones = rows.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, by, order, {alias: "_one"}).drop("_one")


def ntile(rows: DataFrame, by: list[str], order: list[str], tiles: int, alias: str) -> DataFrame:
    """``ntile(tiles)``: groups of rows of equal number, the first ones larger by one where it must be."""
    ones = rows.withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_sum(ones, by, order, {"_upto": "_one"})
    numbered = running_sum(numbered, by, order, {"_from": "_one"}, backwards=True)
    number, total = F.col("_upto"), F.col("_upto") + F.col("_from") - 1
    small, larger = F.call_function("div", total, F.lit(tiles)), F.pmod(total, F.lit(tiles))
    in_larger = larger * (small + 1)
    tile = F.when(
        number <= in_larger, F.call_function("div", number - 1, small + 1)
    ).otherwise(larger + F.call_function("div", number - in_larger - 1, F.greatest(small, F.lit(1))))
    return numbered.withColumn(alias, (tile + 1).cast("int")).drop("_one", "_upto", "_from")
