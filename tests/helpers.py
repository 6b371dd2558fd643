from pyspark.sql import SparkSession


def frame(spark: SparkSession, ddl: str, rows):
    return spark.createDataFrame(rows, ddl)


def rows(df, *order):
    """Rows as tuples, sorted by the given columns (or by everything)."""
    result = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return result if order else sorted(result, key=repr)


def column(df, name, order):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
