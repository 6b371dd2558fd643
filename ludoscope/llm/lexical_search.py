"""Ranked lexical search over all documents for a set of stated items, by a trie of documents.

A document is reduced to the terms that some item holds, ordered by how many documents hold them, the most
frequent first. Documents in that order are the paths of a trie: those that begin alike are neighbours and
share nodes. The trie is cut into subtrees that halve from level to level; each knows, for every term in
it, the largest count and, over its documents, the smallest length measure, which bound every score below
it. For each item the subtrees are searched depth first, the most promising first, and those whose bound
is below the tenth score found so far are left out. Every block of documents is searched by one task, for
all items; a block gives its best documents of each item, and the best of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import stored, with_text_results

TOP = 10
ITEM_TERMS = 400_000  # terms of the items that one search goes out with
DOCUMENTS, POSTINGS = 20_000, 1_500_000  # of a block
LEAF = 32  # documents whose scores are computed together
NUMERATOR, PER_COUNT, PER_MEASURE = 10**9, 1000, 8


# -- documents as vectors over the items' terms ----------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, terms, counts)."""
    for batch in batches:
        for i, j, data, offsets in bw.pieces(batch.column(1)):
            found = bw.words(data, offsets, bw.BY_SYMBOL)
            terms, counts = [], []
            for k in range(j - i):
                hashes, times = np.unique(found.hashes[found.bounds[k] : found.bounds[k + 1]], return_counts=True)
                terms.append(hashes.view(np.int64))
                counts.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=["item", "terms", "counts"],
            )


def _restricted(shared):
    """(n_terms, terms, counts) of whole texts, ``terms`` the numbers of those in the vocabulary, ascending."""

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        vocabulary = shared.value
        found = bw.words(data, offsets, bw.BY_SYMBOL)
        at = np.searchsorted(vocabulary, found.hashes)
        at[at == len(vocabulary)] = 0
        known = np.flatnonzero(vocabulary[at] == found.hashes) if len(vocabulary) else np.zeros(0, np.int64)
        owners = np.searchsorted(found.bounds, known, "right") - 1
        keys, counts = np.unique(owners * max(1, len(vocabulary)) + at[known], return_counts=True)
        owners, terms = np.divmod(keys, max(1, len(vocabulary)))
        lists = pa.array(np.searchsorted(owners, np.arange(len(offsets))).astype(np.int32))
        return [
            pa.array(np.diff(found.bounds)),
            pa.ListArray.from_arrays(lists, pa.array(terms.astype(np.int32))),
            pa.ListArray.from_arrays(lists, pa.array(counts.astype(np.int64))),
        ]

    return per_piece


# -- the trie of one block -------------------------------------------------------------------------


class Trie:
    """Documents of one block in trie order, and the subtrees that bound their scores.

    Of each node: its documents (``low`` to ``high``), its children (nodes ``first`` to ``last``), and its
    terms with the most that each can add to a score, in one run of ``terms`` and ``most``.
    """

    def __init__(self, ids: np.ndarray, measures: np.ndarray, starts: np.ndarray, ranks: np.ndarray, counts: np.ndarray):
        """``ranks`` are the documents' terms by frequency rank, ascending within ``starts``."""
        order, shared = _in_trie_order(starts, ranks, counts, measures, ids)
        lengths = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[order] - self.starts[:-1], lengths) + np.arange(self.starts[-1])
        self.ids, self.measures = ids[order], measures[order]
        self.ranks, self.counts = ranks[places], counts[places]
        self.adds = _adds(self.counts, np.repeat(self.measures, lengths))
        self._cut(shared)

    def _cut(self, shared: np.ndarray) -> None:
        n = len(self.ids)
        low, high, first, last = [0], [n], [0], [0]
        k = 0
        while k < len(low):
            first[k] = last[k] = len(low)
            if high[k] - low[k] > LEAF:
                for a, b in _children(low[k], high[k], shared):
                    low.append(a), high.append(b), first.append(0), last.append(0)
                last[k] = len(low)
            k += 1
        self.low, self.high, self.first, self.last = (np.array(x) for x in (low, high, first, last))
        # Largest count of each term and smallest measure of each subtree, from the documents' postings.
        width = int(self.ranks.max(initial=0)) + 1
        terms, most, bounds = [], [], [0]
        for a, b in zip(low, high, strict=True):
            part = slice(self.starts[a], self.starts[b])
            largest = np.zeros(width, np.int64) if (b - a) * 8 > width else None
            if largest is None:
                ranks, at = np.unique(self.ranks[part], return_inverse=True)
                counts = np.zeros(len(ranks), np.int64)
                np.maximum.at(counts, at, self.counts[part])
            else:
                np.maximum.at(largest, self.ranks[part], self.counts[part])
                ranks = np.flatnonzero(largest)
                counts = largest[ranks]
            terms.append(ranks.astype(np.int32))
            most.append(_adds(counts, np.int64(self.measures[a:b].min(initial=0))))
            bounds.append(bounds[-1] + len(ranks))
        self.terms, self.most, self.bounds = np.concatenate(terms), np.concatenate(most), np.array(bounds)

    def best(self, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``top`` documents of highest score above 0, equal scores by id."""
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = [(1 << 62, 0)]
        while waiting:
            bound, node = waiting.pop()
            if len(scores) == top and bound < scores[-1]:
                continue
            first, last = self.first[node], self.last[node]
            if first < last:
                run = slice(self.bounds[first], self.bounds[last])
                bounds = _sums(weights[self.terms[run]] * self.most[run], self.bounds[first : last + 1])
                least = max(1, scores[-1]) if len(scores) == top else 1
                inside = np.flatnonzero(bounds >= least)
                inside = inside[np.argsort(bounds[inside], kind="stable")]
                waiting.extend(zip(bounds[inside].tolist(), (first + inside).tolist(), strict=True))
                continue
            low, high = self.low[node], self.high[node]
            run = slice(self.starts[low], self.starts[high])
            found = _sums(weights[self.ranks[run]] * self.adds[run], self.starts[low : high + 1])
            some = np.flatnonzero(found >= (max(1, scores[-1]) if len(scores) == top else 1))
            if len(some):
                scores, ids = np.concatenate([scores, found[some]]), np.concatenate([ids, self.ids[low + some]])
                order = np.lexsort((ids, -scores))[:top]
                scores, ids = scores[order], ids[order]
        return scores, ids


def _adds(counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
    return NUMERATOR * counts // (PER_COUNT * counts + PER_MEASURE * measures)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, of which some may be empty."""
    upto = np.concatenate([[0], np.cumsum(values)])
    at = bounds - bounds[0]
    return upto[at[1:]] - upto[at[:-1]]


def _in_trie_order(starts, ranks, counts, measures, ids) -> tuple[np.ndarray, np.ndarray]:
    """Order of the documents by their terms, and how many terms each shares with the one before."""
    big = ranks.astype(">u4")
    paths = [big[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    order = sorted(range(len(paths)), key=paths.__getitem__)
    shared = np.zeros(len(paths), np.int64)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        if paths[a] == paths[b]:
            shared[k] = starts[b + 1] - starts[b]
            continue
        size = min(starts[a + 1] - starts[a], starts[b + 1] - starts[b])
        differ = ranks[starts[a] : starts[a] + size] != ranks[starts[b] : starts[b] + size]
        shared[k] = differ.argmax() if differ.any() else size
    return np.array(order, np.int64), shared


def _children(low: int, high: int, shared: np.ndarray) -> list[tuple[int, int]]:
    """Subtrees of the documents from ``low`` to ``high``, none of more than half of them.

    A run of documents is cut where they share fewest terms, the borders of the trie's children; a part
    that is still larger than half is cut in turn, and neighbours that are small together are joined.
    Documents on one and the same path have no such border and are cut anywhere.
    """
    parts, open_parts = [], [(low, high)]
    half = (high - low) // 2
    while open_parts:
        a, b = open_parts.pop()
        if b - a <= half:
            parts.append((a, b))
            continue
        inner = shared[a + 1 : b]
        at = a + 1 + np.flatnonzero(inner == inner.min())
        if len(at) == b - a - 1:  # no two documents share more than the others
            at = np.arange(a + min(LEAF, half), b, min(LEAF, half))
        borders = [a, *at.tolist(), b]
        open_parts.extend(zip(borders[:-1], borders[1:], strict=True))
    parts.sort()
    joined = [parts[0]]
    for a, b in parts[1:]:
        if b - joined[-1][0] <= max(LEAF, half // 16):
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


# -- the search ------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, documents, postings = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            held.append(part)
            documents, postings = documents + part.num_rows, postings + len(part.column(2).flatten())
            if documents >= DOCUMENTS or postings >= POSTINGS:
                yield pa.Table.from_batches(held)
                held, documents, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search(shared, top: int):
    """(id, measure, terms, counts) to the best (item, id, score) of each block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, items = shared.value
        for block in _blocks(batches):
            block = block.combine_chunks()
            terms = block.column(2).combine_chunks()
            lengths = np.diff(terms.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ranks = rank_of[terms.flatten().to_numpy()]
            counts = block.column(3).combine_chunks().flatten().to_numpy()
            owners = np.repeat(np.arange(len(lengths)), lengths)
            by_rank = np.lexsort((ranks, owners))
            last = np.iinfo(np.int64).max
            ids = block.column(0).fill_null(last).to_numpy()
            trie = Trie(ids, block.column(1).to_numpy(), starts, ranks[by_rank], counts[by_rank])
            weights = np.zeros(len(rank_of), np.int64)
            best = []
            for held, weight in items:
                weights[rank_of[held]] = weight
                best.append(trie.best(weights, top))
                weights[rank_of[held]] = 0
            numbers = np.repeat(np.arange(len(items)), [len(scores) for scores, _ in best])
            none = np.zeros(0, np.int64)
            scores, found = (np.concatenate([none, *(x[k] for x in best)]) for k in range(2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(found, pa.int64(), mask=found == last), pa.array(scores, pa.int64())],
                names=["number", "id", "score"],
            )

    return run


def weight_of(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def search(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    *,
    top: int = TOP,
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of highest score above 0 for every item, from rank 1.

    Equal scores are ranked by ascending id, null ids last. Terms are runs of letters and digits, A-Z in
    lower case, compared by 64-bit hashes; the score is a whole number, from a term's weight, its count in
    the document and the document's length against the mean.

    Null and empty texts have no terms, so such items find nothing and such documents are not found. Rows
    with the same item and terms are one item; the same item with other terms is ranked for each of them.
    Repeated documents are documents and are all ranked; among equal ids any order is right, as their rows are
    alike in rank order. Empty tables give no rows; other columns, of any name, are ignored. Items go out in
    blocks of ITEM_TERMS terms, each searched in all documents.
    """
    kind = items.select(item_column).schema[0].dataType.simpleString()
    named = items.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text"))
    terms = named.where("text is not null").distinct().mapInArrow(_item_terms, f"item {kind}, terms array<long>, counts array<long>")
    placed = terms.where(F.size("terms") > 0).withColumn("place", F.xxhash64("item", "terms", "counts"))
    terms = stored(placed.dropDuplicates(["place"]), "items")
    parts = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    found = [_search_for(texts, terms.where(F.pmod("place", F.lit(parts)) == part), top) for part in range(parts)]
    return reduce(DataFrame.unionByName, found).select("item", "rank", "id", "score")


def _search_for(texts: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """As ``search`` for items whose terms together are bounded, so that they can be sent to every task."""
    spark, context = texts.sparkSession, texts.sparkSession.sparkContext
    rows = items.select("place", "terms", "counts").toArrow()
    held = [np.array(x, np.int64).view(np.uint64) for x in rows.column("terms").to_pylist()]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]))
    fields = "n long, terms array<int>, counts array<long>"
    per_piece = _restricted(context.broadcast(vocabulary))
    vectors = with_text_results(texts, "text", "found", fields, per_piece, keep_text=False)
    vectors = stored(vectors.select("id", "found.*"), "vectors")
    n, total = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequencies[row["term"]] = row["count"]
    rank_of = np.empty(len(vocabulary), np.int64)
    rank_of[np.lexsort((vocabulary, -frequencies))] = np.arange(len(vocabulary))
    weights = np.array([weight_of(n, int(df)) for df in frequencies], np.int64)
    searched = []
    for hashes, counts in zip(held, rows.column("counts").to_pylist(), strict=True):
        at = np.searchsorted(vocabulary, hashes)
        searched.append((at, weights[at] * np.array(counts, np.int64)))
    shared = context.broadcast((rank_of, searched))
    wide = "cast(75 as decimal(2,0)) * cast(n as decimal(17,0)) * cast({} as decimal(17,0)) div {}"
    measured = vectors.where(F.size("terms") > 0).select(
        "id", (F.expr(wide.format(n, max(total, 1))) + 25).cast("long").alias("measure"), "terms", "counts"
    )
    best = measured.mapInArrow(_search(shared, top), "number long, id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(
        [(k, place) for k, place in enumerate(rows.column("place").to_pylist())], "number long, place long"
    )
    return ranked.join(names, "number").join(items.select("place", "item"), "place")
