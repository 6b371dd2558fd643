"""Run registered queries in Spark and their SQL in DuckDB, and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    columns, rows = normalised(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    want_columns, want_rows = normalised(result.columns, result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    want_kinds = {c: str(t) for c, t in zip(result.columns, result.types)}
    if kinds != want_kinds:
        return f"types {sorted(set(kinds.items()) ^ set(want_kinds.items()))}"
    if rows != want_rows:
        extra = [r for r in rows if r not in set(want_rows)][:2]
        missing = [r for r in want_rows if r not in set(rows)][:2]
        return f"{len(rows)} rows, want {len(want_rows)}; {columns}; extra {extra}; missing {missing}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from ludoscope.session import build_session

    sf_dir, wanted = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, statements, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name not in statements:
                problem = "no SQL"
            else:
                problem = compare(build(spark, sf_dir), con, statements[name])
        except Exception as error:  # a broken query is a finding like any other
            problem = f"{type(error).__name__}: {str(error)[:300]} ... {str(error)[-900:]}"
        bad += problem is not None
        print(f"{name:30s} {time.time() - start:6.2f}s {'ok' if problem is None else 'DIFF ' + problem[:1200]}", flush=True)
    print("differences:", bad)
