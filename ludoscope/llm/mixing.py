"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

Every row has a 60-bit number from a hash of its id and text. What a source gives is the rows below a
threshold, so no row is sorted: sizes are summed by source and by the leading bits of the number, the
bucket in which the source's budget ends is cut up by the next bits, and so on until the bucket is one
number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words that the mix takes
MOST = 2  # times that a row is taken at most
LEVELS, BITS = 5, 12


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(id_column: str, text_column: str) -> Column:
    """60 bits of a hash of id and text."""
    plain = F.concat(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_column, F.lit(""))
    )
    return F.conv(F.substring(F.md5(plain.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, in slices that are numbered apart.

    One task holds one range of the sources; only the sizes of the ranges meet in a window.
    """
    last = F.col("source").isNull()
    sliced = stored(
        sources.repartitionByRange(last, "source").withColumn("slice", F.spark_partition_id()), "sources"
    )
    sizes = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("slice").orderBy(last, "source")
    return sliced.join(offsets, "slice").withColumn("rank", F.col("offset") + F.row_number().over(within) - 1)


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target) from the (source, size) of all rows.

    Weights share the mix's words; a source stops at MOST times its size, and what is left over is shared
    by weight among the others until none is above.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = stored(_ranked(sources).select("source", "source_size", weight.alias("weight")), "sources")
    most = MOST * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = most < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (SHARE * total - row[1]) / row[2]
    target = F.least(most.cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): numbers below the threshold fit the source's budget best.

    The number on which the budget ends counts as below if that comes nearer to the budget.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("extra").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        here = (rows if level == 1 else inside).alias("r").join(
            state.alias("s"),
            F.col("r.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright("r.number", shift + BITS) == F.col("s.prefix")),
        )
        inside = here.select("r.source", "r.number", "r.size")
        if 1 < level < LEVELS:
            inside = stored(inside, "boundary")
        sums = (
            here.select("r.source", "s.left", F.shiftright("r.number", shift).alias("bucket"), "r.size")
            .groupBy("source", "left", "bucket")
            .agg(F.sum("size").alias("size"))
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = sums.withColumn("upto", F.sum("size").over(upto))
        crossing = summed.where(F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("bucket", "upto", "size", "left")).alias("at")
        )
        state = stored(
            crossing.select(
                "source",
                F.col("at.bucket").alias("prefix"),
                (F.col("at.left") - (F.col("at.upto") - F.col("at.size"))).alias("left"),
                F.col("at.size").alias("size"),
            ),
            "thresholds",
        )
    taken = (2 * F.col("left") > F.col("size")).cast("long")
    return state.select("source", (F.col("prefix") + taken).alias("threshold"))


def _measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        n_words(text_column).alias("size"),
        _number(id_column, text_column).alias("number"),
    )


def _plan(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, threshold): rows are taken ``whole`` times, and once more below the threshold."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(
        targets(rows)
        .withColumn("whole", F.least(whole, F.lit(MOST)).cast("long"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    cut = _thresholds(rows, plan.where("extra > 0"))
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    whole_plan = plan.alias("p").join(cut.alias("c"), same, "left").select(
        "p.source", "p.source_size", "p.target", "p.whole", F.coalesce("c.threshold", F.lit(0)).alias("threshold")
    )
    # Stored, so that its size is known when it is joined: a small one is broadcast, and no text is shuffled.
    return stored(whole_plan, "plan")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, times, taken) for every row of ``docs``.

    ``size`` is the number of words, 0 for a null or empty text; ``taken`` the words that the mix takes of
    the row, which is the row 0, 1 or 2 ``times``. A source is taken whole as often as its target allows,
    and the rest is the rows whose number is below the source's threshold. Rows that agree in id, text and
    source share a number and are taken alike. A null source is a source, the last one. An empty table
    gives no rows; a source without words has the target 0. Other columns are ignored.
    """
    rows = stored(_measured(docs, id_column, text_column, source_column), "sizes")
    return _times(rows, _plan(rows)).select(
        "r.id", "r.source", "r.size", "p.source_size", "p.target", "times", (F.col("r.size") * F.col("times")).alias("taken")
    )


def _times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    times = F.col("p.whole") + (F.col("r.number") < F.col("p.threshold")).cast("long")
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    return rows.alias("r").join(plan.alias("p"), same).withColumn("times", times)


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and how many ``times`` each is taken.

    As ``mix``; a column of ``docs`` that is called like the new one is replaced.
    """
    measured = _measured(docs, id_column, text_column, source_column)
    plan = _plan(stored(measured, "sizes"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    rows = docs.select(
        whole, F.col(source_column).alias("source"), _number(id_column, text_column).alias("number")
    )
    return (
        _times(rows, plan)
        .where("times > 0")
        .select("r.document", "times")
        .select(*[f"document.`{c}`" for c in docs.columns if c.lower() != "times"], "times")
    )


ORACLE = """
with d as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as num
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
o as (select *, row_number() over (order by 2 * source_size / weight, source) as k,
    coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by 2 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(source_size) over () as total from w),
l as (select *, (cast(1.5 as double) * total - capped) / rest as level from o),
v as (select level as lam from l where 2 * source_size >= level * weight order by k limit 1),
t as (select source, source_size, least(cast(2 * source_size as double), lam * weight) as target from w, v),
p as (select *, case when source_size > 0 then least(floor(target / source_size), 2) else 0 end::bigint as whole from t),
a as (select source, num, sum(size) as size from d group by all),
c as (select source, num, size, sum(size) over (partition by source order by num rows unbounded preceding) as upto from a),
i as (select c.source, c.num from c join p on c.source is not distinct from p.source
  where upto <= target - whole * source_size
    or (upto - size <= target - whole * source_size and 2 * (target - whole * source_size - (upto - size)) > size))
select d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.whole + case when i.num is not null then 1 else 0 end))::bigint as taken
from d join p on d.source is not distinct from p.source
left join i on i.source is not distinct from d.source and i.num = d.num
"""
