"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and those of the lines before and after it;
neighbouring labels are tied by a transition matrix. A document's quality is the mean of its lines'
forward-backward marginals of "good", weighted by the lines' lengths, and mapped to a probability by
a logistic curve.

The field is fitted on a bounded sample of labelled documents, whose lines take their document's label.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .calibration import fit_line, log_odds
from .common import fold, stored, unused, with_text_results

SAMPLE = 3000  # labelled documents that the field is fitted on
SAMPLE_LINES = 200_000  # and their lines at most; the longest documents lend the middle of theirs
CHAIN = 64  # lines of one chain while fitting
STEPS = 120
RUN = 128  # lines of a text that one pass of messages goes through; longer texts are cut into runs
LINES = 100_000  # of one text whose features are held at once
PIECE_BYTES = 1 << 18  # of texts that are scored together

_codes = np.arange(256)
_CLASSES = {
    "upper": (_codes >= 65) & (_codes <= 90),
    "letter": ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128),
    "digit": (_codes >= 48) & (_codes <= 57),
    "blank": bw.SPACE,
    "stop": np.isin(_codes, list(b".,;:'\"()-?")),
}
_CLASSES["symbol"] = ~np.logical_or.reduce(list(_CLASSES.values()))
FEATURES = 2 * len(_CLASSES) + 14
SEEN = 2 * len(_CLASSES) + 10  # place of the feature that an earlier line of the text is equal


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and for each text the range of its lines; an empty text is one line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owners = np.searchsorted(breaks, offsets)
    bounds = owners + np.arange(len(offsets))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = offsets[1:]
    return starts, ends, bounds


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, bounds): one row for each line of the texts."""
    starts, ends, bounds = line_bounds(data, offsets)
    n, size = len(starts), ends - starts
    wide = np.maximum(size, 1)
    columns = [np.ones(n), np.log1p(size) / 5, (size == 0).astype(float)]
    for members in _CLASSES.values():
        upto = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
        share = (upto[ends] - upto[starts]) / wide
        columns += [share, share > 0.25]
    found = bw.words(data, offsets, bw.BY_SPACE)
    line = np.searchsorted(starts, found.starts, "right") - 1
    count = np.bincount(line, minlength=n)
    some = np.maximum(count, 1)
    again = np.zeros(len(line), bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, minlength=n) / some
    order = np.lexsort((found.hashes, line))
    other = np.ones(len(line), bool)
    other[1:] = (found.hashes[order][1:] != found.hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], other, minlength=n) / some
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    seen = _seen(data, starts, ends, text)
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    first = data[np.minimum(starts, len(data) - 1)] if len(data) else np.zeros(n, np.uint8)
    columns += [
        np.log1p(count) / 5,
        size / some / 20,
        repeats,
        repeats > 0.3,
        1 - distinct,
        distinct < 0.5,
        (distinct < 0.5) & (count >= 8),
        seen & (size > 0),
        np.isin(last, list(b".!?")) & (size > 0),
        (_CLASSES["upper"][first] | (first >= 128)) & (size > 0),
        count < 3,
    ]
    return np.stack(columns, axis=1).astype(np.float32), size, bounds


def _seen(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether an earlier line of the same text is equal."""
    n = len(starts)
    whole = bw.range_hashes(data, starts, ends) if len(data) else np.zeros(n, np.uint64)
    seen = np.zeros(n, bool)
    by_line = np.lexsort((np.arange(n), whole, text))
    seen[by_line[1:]] = (whole[by_line][1:] == whole[by_line][:-1]) & (text[by_line][1:] == text[by_line][:-1])
    return seen


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and of the line after, 0 beyond the text."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate([features, before, after], axis=1)


def _local(score: np.ndarray) -> np.ndarray:
    """How much a line's score speaks for bad and for good, the larger as one."""
    score = np.clip(score, -30, 30)
    return np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], axis=1)


def _messages(
    local: np.ndarray, bounds: np.ndarray, move: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of every line, each summing to one.

    All chains move one line in one step, the longest first, so that those still going are a prefix.
    ``before`` and ``behind`` are what comes in at the chains' ends: factors of the first line, and the backward
    message of the last.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    going = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), "right")
    ahead, back = np.empty_like(local), np.ones_like(local)
    if behind is not None:
        back[bounds[1:] - 1] = behind
    for t, k in enumerate(going):
        at = first[:k] + t
        if t:
            now = (ahead[at - 1] @ move) * local[at]
        else:
            now = local[at] if before is None else before[order] * local[at]
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(going) - 2, -1, -1):
        at = first[: going[t + 1]] + t
        now = (local[at + 1] * back[at + 1]) @ move.T
        back[at] = now / now.sum(axis=1, keepdims=True)
    return ahead, back


def _messages_in_runs(local: np.ndarray, bounds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_messages``, for long chains: cut into runs of RUN lines that all move side by side.

    What a run does to a message is a matrix of two by two. These matrices carry the messages from run to
    run, forwards and backwards, and then every run is passed through with what comes in at its ends.
    """
    sizes = np.diff(bounds)
    runs = -(-sizes // RUN)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(bounds[:-1], runs) + nth * RUN
    cuts = np.append(starts, bounds[-1])
    whole = np.tile(np.eye(2), (len(starts), 1, 1))
    for t in range(RUN):
        here = np.flatnonzero(starts + t < cuts[1:])
        now = (whole[here] @ move) * local[starts[here] + t][:, None, :]
        if t == 0:  # no move leads into a chain's first line
            opens = nth[here] == 0
            now[opens] = local[starts[here][opens]][:, None, :]
        whole[here] = now / now.sum(axis=(1, 2), keepdims=True)
    before, behind = np.ones((len(starts), 2)), np.ones((len(starts), 2))
    (m00, m01), (m10, m11) = move.tolist()
    steps = whole.tolist()
    a, b = 0.5, 0.5
    for k, opens in enumerate((nth == 0).tolist()):
        if not opens:
            before[k] = a * m00 + b * m10, a * m01 + b * m11
        (w00, w01), (w10, w11) = steps[k]
        a, b = (w00, w01) if opens else (a * w00 + b * w10, a * w01 + b * w11)
        a, b = a / (a + b), b / (a + b)
    closes = np.append(nth[1:] == 0, True).tolist()
    a, b = 1.0, 1.0
    for k in range(len(steps) - 1, -1, -1):
        if closes[k]:
            a, b = 1.0, 1.0
        behind[k] = a, b
        (w00, w01), (w10, w11) = steps[k]
        a, b = w00 * a + w01 * b, w10 * a + w11 * b
        a, b = a / (a + b), b / (a + b)
    return _messages(local, cuts, move, before, behind)


@dataclass
class Field:
    """Weights of "good" against "bad", and log transitions from label to label (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)  # of the log-odds of a document's mean

    def marginals(self, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected transitions summed over all chains."""
        local, move = _local(features @ self.weights), np.exp(self.moves)
        ahead, back = _messages(local, bounds, move)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        inner = np.ones(len(local), bool)
        inner[bounds[:-1]] = False
        to = np.flatnonzero(inner)
        pairs = ahead[to - 1][:, :, None] * move * (local[to] * back[to])[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        return good, pairs.sum(axis=0)

    def good_lines(self, score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(good) of every line from the lines' scores; chains of any length take RUN steps a pass."""
        local, move = _local(score), np.exp(self.moves)
        if np.diff(bounds).max(initial=0) <= RUN:
            ahead, back = _messages(local, bounds, move)
        else:
            ahead, back = _messages_in_runs(local, bounds, move)
        ahead *= back
        return ahead[:, 1] / ahead.sum(axis=1)

    def means(self, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean marginal of "good" of each text, by length; ``features`` have neighbours already."""
        return self._means(features @ self.weights, size, bounds)

    def _means(self, score: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        good, weight = self.good_lines(score, bounds), size + 1.0
        return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])

    def _scores_of_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and lengths of the lines of one text, whose features are made LINES at a time."""
        starts, ends, bounds = line_bounds(data, np.array([0, len(data)]))
        n = int(bounds[1])
        seen = _seen(data, starts, ends, np.zeros(n, np.int8)) & (ends > starts)
        score = np.empty(n)
        for first in range(0, n, LINES):
            stop = min(first + LINES, n)
            low, high = max(first - 1, 0), min(stop + 1, n)  # with the neighbours of the outer lines
            part = data[starts[low] : ends[high - 1]]
            features, _, own = line_features(part, np.array([0, len(part)]))
            features[:, SEEN] = seen[low:high]
            score[first:stop] = with_neighbours(features, own)[first - low : stop - low] @ self.weights
        return score, ends - starts

    def qualities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and np.count_nonzero(data == 10) >= LINES:
            score, size = self._scores_of_long(data)
            means = self._means(score, size, np.array([0, len(score)]))
        else:
            features, size, bounds = line_features(data, offsets)
            means = self.means(with_neighbours(features, bounds), size, bounds)
        odds = log_odds(means)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * odds + self.curve[1], -30, 30)))


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum conditional likelihood with a Gaussian prior, by Adam on all chains.

    ``features`` have neighbours already; every line of chain i has labels[i].
    """
    lines = np.repeat(labels, np.diff(bounds)).astype(float)
    inner = np.diff(bounds) - 1
    seen = np.diag([inner[labels == 0].sum(), inner[labels == 1].sum()]).astype(float)
    values = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        field = Field(values[:-4], values[-4:].reshape(2, 2))
        good, moves = field.marginals(features, bounds)
        slope = np.concatenate([features.T @ (lines - good), (seen - moves).ravel()]) / len(lines) - 1e-4 * values
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        values = values + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(values[:-4], values[-4:].reshape(2, 2))


def _most_lines(counts: list[int]) -> int:
    """The most lines that every document can lend if SAMPLE_LINES bounds their sum."""
    counts, left = np.sort(np.array(counts, np.int64)), SAMPLE_LINES
    for k, n in enumerate(counts):
        if n * (len(counts) - k) > left:
            return max(left // (len(counts) - k), 1)
        left -= n
    return SAMPLE_LINES


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> list:
    """(label, n_lines, features) of the sampled documents, in the order of their hash."""
    known = (
        labels.where(F.col(label).isin(0, 1) & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("place"))
    )
    chosen = known.orderBy("place", "doc_id").limit(SAMPLE)  # proven bound: SAMPLE rows of three numbers
    texts = stored(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("place", "doc_id", "label")
        .agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
        .select("place", "label", "text"),
        "sample",
    )
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    most = _most_lines([row["n"] for row in texts.select(n_lines.alias("n")).collect()])  # at most SAMPLE rows

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        features, _, bounds = line_features(data, offsets)
        sizes = np.diff(bounds)
        lent = np.minimum(sizes, most)
        firsts = bounds[:-1] + (sizes - lent) // 2
        rows = [features[i : i + n].tobytes() for i, n in zip(firsts, lent, strict=True)]
        return [pa.array(lent), pa.array(rows, pa.binary())]

    found = with_text_results(texts, "text", "lines", "n long, features binary", per_piece, keep_text=False)
    lines = found.select("place", "label", "lines.n", "lines.features")
    return lines.orderBy("place").collect()  # at most SAMPLE_LINES lines


def fit_on(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> Field | float:
    """The fitted field; without labels of both kinds, the smoothed share of label 1."""
    rows = _sample(docs, labels, id_column, text_column, label)
    good = sum(r["label"] for r in rows)
    if not 0 < good < len(rows):
        return (good + 1) / (len(rows) + 2)
    features, bounds, kinds = [], [0], []
    for row in rows:
        own = np.frombuffer(row["features"], np.float32).reshape(row["n"], FEATURES)
        own = with_neighbours(own, np.array([0, len(own)]))
        features.append(own)
        for k in range(0, len(own), CHAIN):
            bounds.append(bounds[-1] + min(CHAIN, len(own) - k))
            kinds.append(row["label"])
    features = np.concatenate(features).astype(float)
    field = fit(features, np.array(bounds), np.array(kinds))
    whole = np.concatenate([[0], np.cumsum([row["n"] for row in rows])])
    size = np.expm1(5 * features[:, 1])  # the feature of the length
    means = log_odds(field.means(features, size, whole))
    return replace(field, curve=fit_line(means, np.array([row["label"] for row in rows])))


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label: str = "quality",
    keep_text: bool = True,
) -> tuple[DataFrame, str]:
    """``docs`` with its quality between 0 and 1, and that column's name.

    Only the text decides. Labels come from rows whose crc32(doc_id as text) mod 5 is not 0, from a sample
    of at most SAMPLE documents; if they have more than SAMPLE_LINES lines, the longest lend as many as all
    together may have, from their middle. Scoring covers all lines. Ids with contradicting labels and labels other than
    0 and 1 are left out. Null and empty texts are scored as one empty line. Without labels of both kinds
    every text gets the smoothed share of label 1. Repeated rows and extra columns stay as they are.
    """
    field = fit_on(docs, labels, id_column, text_column, label)
    name = unused(docs.columns, "score")
    if isinstance(field, float):
        kept = [c for c in docs.columns if keep_text or c != text_column]
        return docs.select(*kept).withColumn(name, F.lit(field)), name

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.clip(field.qualities(data, offsets), 0.0, 1.0))]

    found = with_text_results(
        docs, text_column, name, "value double", per_piece, keep_text=keep_text, piece_bytes=PIECE_BYTES
    )
    return found.withColumn(name, F.col(f"{name}.value")), name
