"""Join of time ranges that overlap, as an equality join on cells of time.

A range belongs to the level whose cells are at least as long as it, so it touches two of them at most;
from level to level cells grow by a factor. Two ranges meet in the cells of the longer one's level: the
shorter one is also listed there, if the other side has ranges of that level. So a range of a year
beside ranges of a minute adds a few rows, not one for each minute. A pair that shares two cells counts
in the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_SECONDS = 3600
FACTOR, LEVELS = 8, 11


def _length(level: int) -> int:
    return CELL_SECONDS * 1_000_000 * FACTOR**level


def _level() -> Column:
    length = F.col("_to") - F.col("_from")
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(length <= _length(n), n).otherwise(level)
    return level


def _ranges(df: DataFrame, by: list[str], start: str, end: str, name: str) -> DataFrame:
    """(by, _from, _to, _level, name) of rows that are ranges, in microseconds."""
    rows = df.select(
        *by, F.unix_micros(start).alias("_from"), F.unix_micros(end).alias("_to"), F.struct(*df.columns).alias(name)
    )
    for column in by:
        rows = rows.filter(F.col(column).isNotNull())
    return rows.filter(F.col("_from") < F.col("_to")).withColumn("_level", _level())


def _in_cells(ranges: DataFrame, levels: list[int], side: str) -> DataFrame:
    """One row for each cell of its own level that a range touches, and of the higher ones among ``levels``."""
    wanted = F.array_distinct(F.concat(F.array("_level"), F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    lengths = F.array(*[F.lit(_length(n)) for n in range(LEVELS)])
    listed = ranges.withColumn("level", F.explode(F.filter(wanted, lambda n: n >= F.col("_level"))))
    length = F.get(lengths, F.col("level"))
    first = F.floor(F.col("_from") / length).cast("bigint")
    last = F.floor((F.col("_to") - 1) / length).cast("bigint")
    placed = listed.withColumns({f"_{side}_first": first, f"_{side}_own": F.col("level") == F.col("_level")})
    return placed.withColumn("cell", F.explode(F.sequence(first, last))).withColumnsRenamed(
        {"_from": f"_{side}_from", "_to": f"_{side}_to"}
    ).drop("_level")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
) -> DataFrame:
    """Structs ``left`` and ``right`` of each pair with equal ``by`` whose ranges share an instant.

    A range runs from its start up to, and without, its end. A row without start, end or key, or whose end is
    not after its start, overlaps nothing. Repeated rows are rows, each with its own pairs.
    """
    a, b = _ranges(left, by, *left_range, "left"), _ranges(right, by, *right_range, "right")
    levels = [sorted(r[0] for r in side.select("_level").distinct().collect()) for side in (a, b)]  # LEVELS at most
    cells_a, cells_b = _in_cells(a, levels[1], "l"), _in_cells(b, levels[0], "r")
    pairs = cells_a.join(cells_b, [*by, "level", "cell"])
    share = (F.col("_l_from") < F.col("_r_to")) & (F.col("_r_from") < F.col("_l_to"))
    once = F.col("cell") == F.greatest("_l_first", "_r_first")
    return pairs.filter(share & once & (F.col("_l_own") | F.col("_r_own"))).select("left", "right")


def at_moments(
    events: DataFrame, ranges: DataFrame, by: list[str], time: str, span: tuple[str, str]
) -> DataFrame:
    """Structs ``left`` (an event) and ``right`` (a range it lies in); an event may lie in several, or in none."""
    moment = F.col(time)
    named = events.withColumns({"_moment": moment, "_after": F.timestamp_micros(F.unix_micros(moment) + 1)})
    found = overlapping(named, ranges, by, ("_moment", "_after"), span)
    return found.withColumn("left", F.col("left").dropFields("_moment", "_after"))
