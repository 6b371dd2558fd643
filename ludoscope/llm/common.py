"""What the operators share: settings, stored intermediate results, folds, aligned output columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialise import stored
from ..session import prepare as prepare_session
from . import bytewords as bw

__all__ = ["OncePerWorker", "ascii_lower", "computed_once", "fold", "prepare", "stored", "table", "unused", "with_text_results"]

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on: small Arrow batches, since a row is a whole text."""
    prepare_session(spark)
    # Where the package is not installed, tasks on this machine still find it beside the driver's copy.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, SMALL)


def fold(key: str, folds: int = 5) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called like it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def computed_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_text_results(
    df: DataFrame,
    text_column: str,
    name: str,
    fields: str,
    per_piece: Callable,
    *,
    keep_text: bool = True,
    piece_bytes: int = bw.PIECE_BYTES,
) -> DataFrame:
    """``df`` with a struct column ``name`` of the ``fields`` that ``per_piece`` derives from whole texts.

    ``per_piece(data, offsets)`` gets the UTF-8 bytes of some rows' texts and returns one Arrow array per
    field. Texts are handed over in pieces of bounded size, a longer text alone. Without ``keep_text`` the
    text column does not travel back.
    """
    fields_type = T.StructType.fromDDL(fields)
    position = df.columns.index(text_column)
    kept = [i for i in range(len(df.columns)) if keep_text or i != position]
    schema = T.StructType([df.schema[i] for i in kept] + [T.StructField(name, fields_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in bw.pieces(batch.column(position), piece_bytes):
                arrays = per_piece(data, offsets)
                part = batch.slice(i, j - i)
                struct = pa.StructArray.from_arrays(arrays, names=fields_type.names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept] + [struct], names=schema.names
                )

    return df.mapInArrow(run, schema)


class OncePerWorker:
    """What a worker derives from a broadcast value: built on first use and kept until another one comes."""

    def __init__(self, build: Callable):
        self.build, self.source, self.built = build, None, None

    def __call__(self, shared, *settings):
        if self.source is not shared:
            self.source, self.built = shared, self.build(shared.value, *settings)
        return self.built
