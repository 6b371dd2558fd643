"""Toxicity by a classifier chain over label categories.

The categories are predicted one after another. Each has a logistic model, linear in the presence of words
and of their first bytes and in the log-odds of the categories before it; those log-odds come from
out-of-fold predictions while fitting, and from the earlier models when a text is scored. The same
out-of-fold predictions calibrate each category's probability. The last category is the one asked for;
earlier ones tell apart what else makes a text unusual.

The models are fitted on a bounded sample of labelled documents and scored on whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .calibration import fit_line
from .common import fold, stored, unused, with_text_results

SAMPLE = 6000  # labelled documents that the models are fitted on
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features beside the word
KEPT = 4096  # features of one category's model
LEAST = 3  # documents that a feature of a model occurs in
FOLDS = 3
STEPS = 80
SPARSE = 4e-4  # strength of the absolute-value penalty

_FILTER_BITS = 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature code) of every word and word beginning, with repeats."""
    found = bw.words(data, offsets, bw.BY_SYMBOL)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.bounds))
    low, codes, texts = bw.LOWER[data], [found.hashes], [text]
    for size in PREFIXES:
        long = found.ends - found.starts > size
        starts = found.starts[long]
        codes.append(bw.mix(bw.range_hashes(low, starts, starts + size) + np.uint64(size)))
        texts.append(text[long])
    return np.concatenate(texts), np.concatenate(codes)


@dataclass
class Model:
    """Logistic model of one category."""

    codes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    chain: np.ndarray  # weights of the earlier categories' log-odds
    curve: tuple[float, float] = (1.0, 0.0)  # of the log-odds, fitted out of fold


def _fit(rows: np.ndarray, columns: np.ndarray, n_columns: int, earlier: np.ndarray, labels: np.ndarray):
    """Weights, bias and chain weights by accelerated proximal gradient steps with an absolute-value penalty.

    (rows, columns) are the places of ones in a sparse matrix.
    """
    n = len(labels)
    share = np.clip(labels.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
    values = np.zeros(n_columns + earlier.shape[1] + 1)
    values[-1] = np.log(share / (1 - share))
    ahead, pace = values.copy(), 1.0
    counts = np.bincount(columns, minlength=n_columns) / n
    # Steps per column: a rare feature moves further than a common one.
    step = 2.0 / np.concatenate([np.sqrt(counts) * 2 + 0.02, (earlier**2).mean(axis=0) * 4 + 1, [2.0]])
    for _ in range(STEPS):
        odds = np.bincount(rows, ahead[columns], n) + earlier @ ahead[n_columns:-1] + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels
        slope = np.concatenate([np.bincount(columns, error[rows], n_columns), earlier.T @ error, [error.sum()]]) / n
        moved = ahead - step * slope
        moved[:n_columns] = np.sign(moved[:n_columns]) * np.maximum(np.abs(moved[:n_columns]) - step[:n_columns] * SPARSE, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / next_pace * (moved - values) * 0.9
        values, pace = moved, next_pace
    return values[:n_columns], values[n_columns:-1], float(values[-1])


def _odds(model: Model, rows: np.ndarray, codes: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    """Log-odds of n texts from their distinct (row, code) pairs."""
    odds = np.full(n, model.bias) + earlier @ model.chain
    if len(model.codes):
        at = np.minimum(np.searchsorted(model.codes, codes), len(model.codes) - 1)
        known = model.codes[at] == codes
        odds += np.bincount(rows[known], model.weights[at[known]], n)
    return np.clip(odds, -30, 30)


def _train(rows: np.ndarray, codes: np.ndarray, earlier: np.ndarray, labels: np.ndarray) -> Model:
    """One category's model over the KEPT features that tell its labels apart best."""
    names, at = np.unique(codes, return_inverse=True)
    n = len(labels)
    with_label = np.bincount(at, labels[rows], len(names))
    count = np.bincount(at, minlength=len(names))
    share = labels.mean()
    gain = _gain(with_label, count, share)
    gain[count < LEAST] = 0
    best = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    used = place[at] >= 0
    weights, chain, bias = _fit(rows[used], place[at[used]], len(best), earlier, labels)
    some = weights != 0
    return Model(names[best][some], weights[some], bias, chain)


def train_chain(rows: np.ndarray, codes: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Model]:
    """Models of all categories; (rows, codes) are distinct, ``labels`` is (n, categories)."""
    n, models = len(labels), []
    earlier = np.zeros((n, 0))
    for category in range(labels.shape[1]):
        y = labels[:, category].astype(float)
        odds = np.zeros(n)
        for k in range(FOLDS):
            inside, outside = folds != k, folds == k
            renumber = np.cumsum(inside) - 1
            used = inside[rows]
            part = _train(renumber[rows[used]], codes[used], earlier[inside], y[inside])
            odds[outside] = _odds(part, rows[~used], codes[~used], n, earlier)[outside]
        models.append(replace(_train(rows, codes, earlier, y), curve=fit_line(odds, y)))
        earlier = np.column_stack([earlier, odds])
    return models


def _sampled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, categories: dict[str, Column]) -> DataFrame:
    """(place, categories, codes) of the sampled documents, ``codes`` their distinct features."""
    names = list(categories)
    plain = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()])
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).isin(0, 1)
    agree = F.lit(True)
    for n in names:
        agree = agree & (F.col(n) == F.col(f"{n}_most"))
    known = (
        plain.where(valid & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(*[F.min(n).alias(n) for n in names], *[F.max(n).alias(f"{n}_most") for n in names])
        .where(agree)
        .select("doc_id", *names, F.xxhash64("doc_id").alias("place"))
    )
    chosen = known.orderBy("place", "doc_id").limit(SAMPLE)  # proven bound: SAMPLE rows of a few numbers
    texts = (
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "place", *names)
        .agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    )

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        text, codes = features(data, offsets)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(offsets)))
        return [pa.array([np.unique(codes[order[a:b]]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())]

    found = with_text_results(texts, "text", "found", "codes binary", per_piece, keep_text=False)
    return found.select("place", *names, "found.codes")


def _counts(categories: int):
    """(fold, labels, codes) to (code, counts): by fold the documents with a feature, and those with each label."""
    width = 1 + categories

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(c.as_buffer(), np.uint64) for c in batch.column(2)]
            names, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
            owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            folds = batch.column(0).to_numpy()[owner]
            truth = np.array(batch.column(1).to_pylist(), np.int64).reshape(len(codes), categories)[owner]
            sums = np.zeros((len(names), FOLDS, width), np.int64)
            np.add.at(sums, (at, folds, 0), 1)
            for k in range(categories):
                np.add.at(sums, (at, folds, 1 + k), truth[:, k])
            cuts = pa.array(np.arange(len(names) + 1, dtype=np.int32) * FOLDS * width)
            lists = pa.ListArray.from_arrays(cuts, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), lists], names=["code", "counts"])

    return run


def _gain(with_label, count, share):
    """How well a feature tells the labels apart."""
    return (with_label - count * share) * (with_label - count * share) / (count + 2)


def _candidates(rows: DataFrame, truth: np.ndarray, folds: np.ndarray) -> DataFrame:
    """The codes that any category's model, or its model without one fold, may take: its KEPT best by gain."""
    width = 1 + truth.shape[1]
    sums = [F.sum(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(FOLDS * width)]
    counted = rows.mapInArrow(_counts(truth.shape[1]), "code long, counts array<long>").groupBy("code").agg(*sums)
    counted, best = stored(counted, "features"), None
    for category in range(truth.shape[1]):
        for left_out in (None, *range(FOLDS)):
            used = [k for k in range(FOLDS) if k != left_out]
            share = float(truth[np.isin(folds, used), category].mean())
            count = sum((F.col(f"c{k * width}") for k in used), F.lit(0))
            with_label = sum((F.col(f"c{k * width + 1 + category}") for k in used), F.lit(0))
            ranked = counted.where(count >= LEAST).select("code", _gain(with_label, count, F.lit(share)).alias("gain"))
            top = ranked.orderBy(F.desc("gain"), "code").limit(KEPT).select("code")
            best = top if best is None else best.unionByName(top)
    return best.distinct()


def _only(shared):
    """(place, codes) to (place, numbers of the wanted codes)."""

    def run(batches):
        for batch in batches:
            found = []
            for codes in batch.column(1):
                codes, wanted = np.frombuffer(codes.as_buffer(), np.uint64), shared.value
                at = np.minimum(np.searchsorted(wanted, codes), max(len(wanted) - 1, 0))
                found.append((at[wanted[at] == codes] if len(wanted) else at[:0]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["place", "numbers"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, categories: dict[str, Column]):
    """(labels, fold, rows, codes) of the sampled documents.

    Features are counted by label where the documents are, and only those that a model may take come here:
    SAMPLE documents with KEPT numbers for each category and fold at most, whatever the texts' length.
    """
    names, spark = list(categories), docs.sparkSession
    found = stored(_sampled(docs, labels, id_column, text_column, categories), "sample")
    heads = found.select("place", *names).orderBy("place").collect()  # at most SAMPLE rows of a few numbers
    truth = np.array([[r[n] for n in names] for r in heads], np.int64).reshape(len(heads), len(names))
    folds = np.arange(len(heads)) % FOLDS
    if len(heads) < 2 * FOLDS:
        return truth, folds, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    dealt = spark.createDataFrame([(r["place"], int(f)) for r, f in zip(heads, folds, strict=True)], "place long, fold int")
    rows = found.join(F.broadcast(dealt), "place").select("fold", F.array(*names).alias("truth"), "codes")
    wanted = _candidates(rows, truth, folds).toArrow().column("code").to_numpy()
    wanted = np.sort(wanted.view(np.uint64))
    shared = spark.sparkContext.broadcast(wanted)
    kept = found.select("place", "codes").mapInArrow(_only(shared), "place long, numbers binary").orderBy("place").collect()
    numbers = [np.frombuffer(r["numbers"], np.int32) for r in kept]
    owner = np.repeat(np.arange(len(kept)), [len(x) for x in numbers])
    return truth, folds, owner, wanted[np.concatenate(numbers)]


def with_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_text: bool = True,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct of one probability per category, and that column's name.

    ``categories`` maps names, in the order of the chain, to 0/1 expressions over ``labels``, which has one
    row per doc_id; ids with contradicting or missing labels are left out, and so are those whose
    crc32(doc_id as text) mod 5 is 0. Null and empty texts have no words. A category whose sample holds
    one label only gets its smoothed share, without labels one half. Repeated rows, extra and equally
    named columns stay as they are.
    """
    truth, folds, rows, codes = _sample(docs, labels, id_column, text_column, categories)
    names = list(categories)
    name = unused(docs.columns, "toxicity")
    models = train_chain(rows, codes, truth, folds) if len(truth) >= 2 * FOLDS else None
    fields = ", ".join(f"{n} double" for n in names)
    all_codes = np.unique(np.concatenate([m.codes for m in models])) if models else np.zeros(0, np.uint64)

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        if models is None:
            return [pa.array(np.full(n, 0.5))] * len(names)
        text, found = features(data, offsets)
        asked = np.zeros(1 << _FILTER_BITS, bool)
        asked[(all_codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        maybe = asked[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        text, found = text[maybe], found[maybe]
        if len(all_codes):
            at = np.minimum(np.searchsorted(all_codes, found), len(all_codes) - 1)
            known = all_codes[at] == found
            distinct = np.unique(text[known] * len(all_codes) + at[known])
            text, found = distinct // len(all_codes), all_codes[distinct % len(all_codes)]
        earlier, out = np.zeros((n, 0)), []
        for model in models:
            odds = _odds(model, text, found, n, earlier)
            earlier = np.column_stack([earlier, odds])
            out.append(pa.array(1 / (1 + np.exp(-np.clip(model.curve[0] * odds + model.curve[1], -30, 30)))))
        return out

    return with_text_results(docs, text_column, name, fields, per_piece, keep_text=keep_text), name
