"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components.

In each of several tables a vector's bucket is the signs of random projections. The number of signs follows
the number of vectors, so that buckets stay small, and the number of tables follows the signs, so that the
same share of pairs is found. Equal vectors are one class with a multiplicity. Classes that share a bucket are compared exactly, in blocks of bounded size, so
that a bucket that holds a large share of all rows is split over tasks and its pairs are never written
out: a block returns, for each class, the multiplicities linked to it and one edge to its group.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as bw
from .common import stored
from .components import components

MISS = 3e-4  # probability that a pair at the cosine shares no bucket
LEAST_BITS, MOST_BITS = 8, 48
BLOCK = 512
SMALL = 32  # rows of a block up to which pairs are compared by shifting rows
CHUNK = 8192  # rows of the blocks that one call compares
NEAR = 1e-6  # pairs this close to the cosine are candidates, whatever the order of a product's additions
DIMENSIONS = 256  # that are projected at a time


def tables_for(vectors: int, cosine: float) -> tuple[int, int]:
    """Signs of a bucket, as many as the bits of the number of vectors, and the tables that they take.

    A random hyperplane separates vectors at an angle with the probability angle / pi.
    """
    bits = min(max(LEAST_BITS, (max(vectors, 1) - 1).bit_length()), MOST_BITS)
    together = (1 - acos(min(max(cosine, -1.0), 1.0)) / pi) ** bits
    return bits, 1 if together >= 1 else ceil(log(MISS) / log1p(-together))


@lru_cache(maxsize=8)
def _planes(first: int, columns: int) -> np.ndarray:
    """Random directions in DIMENSIONS dimensions from the first one on."""
    return np.random.default_rng([11, first]).standard_normal((DIMENSIONS, columns))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that no square or sum overflows or vanishes."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _buckets(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    scaled, sums = _scaled(vectors), np.zeros((len(vectors), tables * bits))
    for first in range(0, scaled.shape[1], DIMENSIONS):
        part = scaled[:, first : first + DIMENSIONS]
        sums += part @ _planes(first, tables * bits)[: part.shape[1]]
    return (sums >= 0).reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _codes(vectors: np.ndarray) -> np.ndarray:
    """64 bits that stand for each row of numbers."""
    size = vectors.shape[1]
    mixed = bw.mix(vectors.view(np.uint64) + np.uint64(size))
    total = np.full(len(vectors), size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + mixed[:, k]
        total ^= total >> np.uint64(29)
    return bw.mix(total).view(np.int64)


def _usable(kind: type):
    """(id, vector) to (id, class, length, components as bytes of ``kind``); no class for an unusable vector."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            lengths = vectors.value_lengths().fill_null(0).to_numpy()
            starts = np.cumsum(lengths) - lengths
            flat = vectors.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros, nulls as NaN
            n = batch.num_rows
            classes, used, raw = np.zeros(n, np.int64), np.zeros(n, bool), [None] * n
            for length in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == length)
                rows = values[starts[at][:, None] + np.arange(length)]
                good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
                at, rows = at[good], rows[good]
                if not len(at):
                    continue
                classes[at], used[at] = _codes(rows), True
                for i, row in zip(at, rows.astype(kind), strict=True):
                    raw[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(classes, mask=~used),
                    pa.array(lengths.astype(np.int32), mask=~used),
                    pa.array(raw, pa.binary()),
                ],
                names=["id", "class", "length", "vector"],
            )

    return run


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of ``width`` numbers out of their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _bucket_kind(bits: int) -> type:
    return next(kind for kind in (np.uint16, np.uint32, np.uint64) if bits <= 8 * kind().nbytes)


def _with_buckets(bits: int, tables: int, kind: type):
    """(class, length, vector) to (class, buckets): the bytes of a number for each table."""

    def run(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for length in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                vectors = _matrix(part.column(2), int(length), kind).astype(np.float64)
                buckets = _buckets(vectors, bits, tables).astype(_bucket_kind(bits))
                packed = pa.array([row.tobytes() for row in buckets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["class", "buckets"])

    return run


def _bucket_rows(bits: int, tables: int):
    """(class, length, buckets) to one row (class, length, slot, bucket) for each table."""

    def run(batches):
        for batch in batches:
            buckets = _matrix(batch.column(2), tables, _bucket_kind(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), tables)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), tables)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(buckets))),
                    pa.array(buckets.ravel()),
                ],
                names=["class", "length", "slot", "bucket"],
            )

    return run


def _near_pairs(vectors: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs a < b of one block whose unit vectors reach the cosine; blocks are runs of rows.

    Products find the candidates; what decides is one sum over the components, whatever the block.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    block = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, min(SMALL, sizes.max(initial=0))):
        a = np.flatnonzero(small[:-shift] & (block[:-shift] == block[shift:]))
        out.append((a, a + shift))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        part = vectors[start : start + size]
        a, b = np.nonzero(np.triu(part @ part.T >= cosine - NEAR, 1))
        out.append((a + start, b + start))
    near = []
    for a, b in out:
        for k in range(0, len(a), CHUNK):
            at, to = a[k : k + CHUNK], b[k : k + CHUNK]
            reach = np.einsum("ij,ij->i", vectors[at], vectors[to]) >= cosine
            near.append((at[reach], to[reach]))
    return tuple(np.concatenate(x) for x in zip(*(near or out), strict=True))


def _compare(cosine: float, bits: int, tables: int, kind: type):
    """Many blocks: (class, links, other) with the multiplicities linked to a class and an edge to its group.

    A pair counts in the first table in which it shares a bucket, so in one block only.
    """

    def of_one_length(part: pa.Table, length: int) -> list[np.ndarray]:
        names = ("slot", "bucket", "low", "high", "side")
        keys = [part.column(c).to_numpy().astype(np.int64) for c in names]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        slot, _, low, high, side = keys
        begins = np.ones(len(order), bool)
        begins[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys[:4]])
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(order)))
        classes, copies = part.column("class").to_numpy()[order], part.column("copies").to_numpy()[order]
        unit = _scaled(_matrix(part.column("vector").combine_chunks(), length, kind)[order].astype(np.float64))
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        buckets = _matrix(part.column("buckets").combine_chunks(), tables, _bucket_kind(bits))[order]
        a, b = _near_pairs(unit, starts, sizes, cosine)
        across = (low[a] == high[a]) | (side[a] != side[b])
        a, b = a[across], b[across]
        fresh = np.ones(len(a), bool)
        for k in range(0, len(a), 4096):
            at, to = a[k : k + 4096], b[k : k + 4096]
            fresh[k : k + 4096] = (buckets[at] == buckets[to]).argmax(axis=1) == slot[at]
        a, b = a[fresh], b[fresh]
        links = np.bincount(a, copies[b], len(order)) + np.bincount(b, copies[a], len(order))
        group = np.arange(len(order))
        while len(a):
            least = np.minimum(group[a], group[b])
            if (group[a] == least).all() and (group[b] == least).all():
                break
            np.minimum.at(group, group[a], least)
            np.minimum.at(group, group[b], least)
            group = group[group]
        some = np.flatnonzero(links)
        return [classes[some], links[some].astype(np.int64), classes[group[some]]]

    def run(chunk: pa.Table) -> pa.Table:
        lengths = chunk.column("length").to_numpy()
        found = [
            of_one_length(chunk.take(pa.array(np.flatnonzero(lengths == length))), int(length))
            for length in np.unique(lengths)
        ]
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], names=["class", "links", "other"])

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, cosine: float = 0.95
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are linked if their cosine, in double precision, is at least ``cosine`` and they share a bucket;
    equal vectors always are. n_links counts the other rows linked directly; component_id is the smallest
    id that links reach. A vector that is null, empty, zero, or has null or non-finite components links with
    nothing and is its own component; vectors of different lengths are never linked. A row with a null id counts as a link and gets its component's smallest id, or null. Repeated
    rows are rows. An empty table gives no rows; other columns are ignored.
    """
    pairs = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    # Components travel as they come, in four bytes or eight; all arithmetic is in double precision.
    single = isinstance(getattr(pairs.schema["vector"].dataType, "elementType", None), T.FloatType)
    kind = np.float32 if single else np.float64
    rows = stored(pairs.mapInArrow(_usable(kind), "id long, class long, length int, vector binary"), "vectors")
    classes = stored(
        rows.where("class is not null")
        .groupBy("class")
        .agg(
            F.count("*").alias("copies"),
            F.min("id").alias("least_id"),
            F.min("length").alias("length"),
            F.min("vector").alias("vector"),
        ),
        "classes",
    )
    bits, tables = tables_for(classes.count(), cosine)
    hashed = stored(
        classes.select("class", "length", "vector").mapInArrow(_with_buckets(bits, tables, kind), "class long, buckets binary")
        .join(classes, "class"),
        "hashed",
    )
    keys = ["slot", "length", "bucket"]
    buckets = hashed.select("class", "length", "buckets").mapInArrow(
        _bucket_rows(bits, tables), "class long, length int, slot int, bucket long"
    )
    shared = buckets.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    members = buckets.join(shared, keys)
    count = F.ceil(F.col("size") / BLOCK)
    dealt = members.withColumn("side", F.pmod(F.xxhash64("class"), count)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    )
    blocks = stored(
        dealt.select(
            "class", *keys, "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")
        ),
        "blocks",
    )
    # Blocks are dealt into chunks of about CHUNK rows; a block has at most two sides of about BLOCK rows.
    chunks = max(1, -(-blocks.count() // CHUNK))
    chunk = F.pmod(F.xxhash64(*keys, "low", "high"), F.lit(chunks)).alias("chunk")
    whole = blocks.select("*", chunk).join(hashed.select("class", "copies", "vector", "buckets"), "class")
    found = stored(
        whole.groupBy("chunk").applyInArrow(_compare(cosine, bits, tables, kind), "class long, links long, other long"), "links"
    )
    parts = components(found, "class", "other")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = (
        classes.select("class", "copies", "least_id")
        .join(links, "class", "left")
        .join(parts.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "copies", "least_id", "links", F.coalesce("component", "class").alias("component"))
    )
    whole = stored(whole, "grouped")
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = whole.join(least, "component")
    linked = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.select("id", "class")
        .join(by_class, "class", "left")
        .select("id", F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
