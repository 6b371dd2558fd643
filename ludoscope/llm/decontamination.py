"""Benchmark decontamination by Wu-Manber search over words.

The strings searched for are windows of 13 consecutive words of a benchmark item; a shorter item is one
window. Words are 64-bit codes and play the part of characters. For the windows of one length, a shift
table over blocks of two words tells how far the end of the search window may jump; a shift of zero
leads to a bucket, chosen by the hash of the last block and of the first, whose strings are compared
word by word. Many texts are searched side by side, one numpy step moving all of them.

Windows go to the tasks in blocks of at most ``WINDOWS`` strings, each with a number that stands for the set of
items that hold it; the items themselves are joined to what was found. So what is broadcast is bounded
however large the benchmark is, and however many items share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import OncePerWorker, stored, unused, with_text_results

LENGTH = 13
WINDOWS = 200_000  # strings of one broadcast block, about 25 MB
LANE = 512  # positions of a text that one lane of the search covers
TABLE_BITS = 20

_FIELDS = "n_words long, n_hit long, holders array<long>, ranges array<struct<start: long, end: long>>"


def _windows(length: int):
    """(item, text) to (item, words of one window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, codes = [], []
            for i, j, data, offsets in bw.pieces(batch.column(1)):
                found = bw.words(data, offsets, bw.BY_SYMBOL)
                for k in range(j - i):
                    hashes = found.hashes[found.bounds[k] : found.bounds[k + 1]]
                    size = min(length, len(hashes))
                    for at in range(len(hashes) - size + 1 if size else 0):
                        items.append(batch.column(0)[i + k])
                        codes.append(hashes[at : at + size].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, batch.column(0).type), pa.array(codes, pa.binary())], names=["item", "window"]
            )

    return run


def _block_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - TABLE_BITS)


@dataclass
class _Strings:
    """Search tables for strings of one length."""

    size: int
    codes: np.ndarray  # strings by words, in bucket order
    shifts: np.ndarray
    buckets: np.ndarray  # sorted keys of the strings
    holders: np.ndarray  # numbers of the sets of items that hold them

    @classmethod
    def of(cls, codes: np.ndarray, holders: np.ndarray) -> _Strings:
        size = codes.shape[1]
        block = min(2, size)
        shifts = np.full(1 << TABLE_BITS, size - block + 1, np.int16)
        for end in range(size, block - 1, -1):  # an earlier end has the larger shift
            at = _block_hash(codes[:, end - block], codes[:, end - 1]).astype(np.int64)
            np.minimum.at(shifts, at, size - end)
        keys = cls.keys(codes[:, 0], codes[:, block - 1], codes[:, size - block], codes[:, size - 1])
        order = np.argsort(keys)
        return cls(size, codes[order], shifts, keys[order], holders[order])

    @staticmethod
    def keys(first, second, before_last, last) -> np.ndarray:
        """The last block's hash above the first block's."""
        return (_block_hash(before_last, last) << np.uint64(TABLE_BITS)) | _block_hash(first, second)

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, string) of all occurrences in the texts of ``bounds``, by position of the first word."""
        size, block = self.size, min(2, self.size)
        counts = np.maximum(np.diff(bounds) - size + 1, 0)
        lanes = -(-counts // LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(bounds[:-1], lanes) + size - 1 + nth * LANE
        end = np.minimum(at + LANE, np.repeat(bounds[1:], lanes))
        stops = []
        while len(at):
            shift = self.shifts[_block_hash(codes[at - block + 1], codes[at]).astype(np.int64)]
            stops.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < end
            at, end = at[going], end[going]
        starts = np.concatenate(stops or [np.zeros(0, np.int64)]) - size + 1
        last = starts + size - 1
        keys = self.keys(codes[starts], codes[starts + block - 1], codes[last - block + 1], codes[last])
        low, high = (np.searchsorted(self.buckets, keys, side) for side in ("left", "right"))
        starts, low, count = (x[high > low] for x in (starts, low, high - low))
        tests = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        starts = np.repeat(starts, count)
        for k in range(size):
            same = codes[starts + k] == self.codes[tests, k]
            starts, tests = starts[same], tests[same]
        return starts, tests


def _tables(rows: list[tuple]) -> list[_Strings]:
    """Search tables, one for each length, of (window, holders) rows."""
    by_size: dict[int, list[tuple]] = {}
    for window, holders in rows:
        by_size.setdefault(len(window) // 8, []).append((window, holders))
    return [
        _Strings.of(
            np.frombuffer(b"".join(w for w, _ in same), np.uint64).reshape(len(same), size), np.array([h for _, h in same], np.int64)
        )
        for size, same in by_size.items()
    ]


_built = OncePerWorker(_tables)


def _searcher(shared):
    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found = bw.words(data, offsets, bw.BY_SYMBOL)
        marks = np.zeros(len(found.starts) + 1, np.int64)
        none = np.zeros(0, np.int64)
        owners, holders = [none], [none]
        for strings in _built(shared):
            starts, tests = strings.search(found.hashes, found.bounds)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + strings.size, -1)
            owners.append(np.searchsorted(found.bounds, starts, "right") - 1)
            holders.append(strings.holders[tests])
        pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(holders)], axis=1), axis=0)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(offsets))).astype(np.int32)
        hit = np.cumsum(marks[:-1]) > 0
        ranges = _ranges(hit, found.bounds)
        hits = np.concatenate([[0], np.cumsum(hit)])[found.bounds]
        return [
            pa.array(np.diff(found.bounds)),
            pa.array(np.diff(hits)),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(pairs[:, 1]))),
            pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]

    return per_piece


def _ranges(hit: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    """Runs of hit words of each text, as word numbers."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    if hit.any():
        padded = np.concatenate([[False], hit, [False]])
        padded_before, begins = padded[:-1], np.zeros(len(hit) + 1, bool)
        begins[bounds[:-1]] = True
        first = np.flatnonzero(padded[1:-1] & (~padded_before[:-1] | begins[:-1]))
        last = np.flatnonzero(padded[1:-1] & (~padded[2:] | begins[1:]))
        for text, a, b in zip(np.searchsorted(bounds, first, "right") - 1, first, last + 1, strict=True):
            out[text].append({"start": int(a - bounds[text]), "end": int(b - bounds[text])})
    return out


def _found(
    docs: DataFrame, benchmark: DataFrame, text_column: str, item_column: str, item_text_column: str, length: int, keep_text: bool
) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with what is hit and the holders' numbers, that column's name, and (holder, items)."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).alias("text"))
    grouped = (
        items.mapInArrow(_windows(length), "item string, window binary")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    windows = stored(grouped.withColumn("holder", F.xxhash64("items")), "windows")
    holders = windows.groupBy("holder").agg(F.any_value("items").alias("items"))
    blocks = max(1, -(-windows.count() // WINDOWS))
    name = unused(docs.columns, "contamination")
    context = docs.sparkSession.sparkContext
    found, parts = docs, []
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window", "holder").collect()
        shared = context.broadcast([(bytes(r["window"]), r["holder"]) for r in rows])
        part = unused(found.columns, f"{name}_{block}")
        found = with_text_results(
            found, text_column, part, _FIELDS, _searcher(shared), keep_text=keep_text or block < blocks - 1
        )
        parts.append(part)
        if block < blocks - 1:
            found = stored(found, "contamination")
    return _merged(found, parts, name), name, holders


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    length: int = LENGTH,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; see ``contamination``."""
    found, name, _ = _found(docs, benchmark, text_column, item_column, item_text_column, length, True)
    return found.where(~F.col(name)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    length: int = LENGTH,
    keep_text: bool = True,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_words, n_hit, items, ranges, contaminated; and that column's name.

    A word is hit if any occurrence of a window covers it; ``items`` are the ids, as sorted strings, of
    items with an occurring window, ``ranges`` the hit runs in words. A text is contaminated if it has hit
    words and they are at least a twentieth of its words. Null and empty texts have no words; an item
    without words or an empty benchmark finds nothing; items with a null id mark words but are not listed.
    Repeated rows, extra and equally named columns stay as they are. Two words are taken as equal if
    their 64-bit codes are.

    Texts that hold windows of the same holders share one list of items, which is put together once.
    """
    found, name, holders = _found(docs, benchmark, text_column, item_column, item_text_column, length, keep_text)
    result, key = F.col(name), unused(found.columns, "held_by")
    found = stored(found, "contamination") if not keep_text else found
    lists = found.select(result["holders"].alias("held")).where(F.size("held") > 0).distinct()
    each = lists.select(F.xxhash64("held").alias("key"), F.explode("held").alias("holder")).join(holders, "holder")
    items = each.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found_items"))
    named = items.select(F.col("key").alias(f"{key}_of"), F.col("found_items").alias(f"{key}_items"))
    # Most texts hold nothing; each has a key of its own, so that none is hot.
    holds = F.size(result["holders"]) > 0
    keyed = found.withColumn(key, F.xxhash64(F.monotonically_increasing_id())).withColumn(
        key, F.when(holds, F.xxhash64(result["holders"])).otherwise(F.col(key))
    )
    joined = keyed.join(named, F.col(key) == F.col(f"{key}_of"), "left")
    none = F.array().cast("array<string>")
    whole = F.struct(
        result["n_words"].alias("n_words"),
        result["n_hit"].alias("n_hit"),
        F.when(holds, F.col(f"{key}_items")).otherwise(none).alias("items"),
        result["ranges"].alias("ranges"),
        result["contaminated"].alias("contaminated"),
    )
    return joined.withColumn(name, whole).drop(key, f"{key}_of", f"{key}_items"), name


def _merged(found: DataFrame, parts: list[str], name: str) -> DataFrame:
    """One result of the results of all blocks."""
    n_words = F.col(f"{parts[0]}.n_words")
    n_hit, holders, ranges = (F.col(f"{parts[0]}.{c}") for c in ("n_hit", "holders", "ranges"))
    if len(parts) > 1:
        holders = F.sort_array(F.array_distinct(F.concat(*[F.col(f"{p}.holders") for p in parts])))
        ranges = F.array_sort(F.concat(*[F.col(f"{p}.ranges") for p in parts]))
        ranges = F.aggregate(
            ranges,
            F.slice(ranges, 1, 0),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
                F.concat(
                    F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                    F.array(
                        F.struct(
                            F.element_at(done, -1)["start"].alias("start"),
                            F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(F.concat(done, F.array(x))),
        )
        n_hit = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    whole = F.struct(
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        holders.alias("holders"),
        ranges.alias("ranges"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )
    return found.withColumn(name, whole).drop(*parts)
