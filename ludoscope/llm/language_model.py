"""Language-model scores by online logistic context mixing over bits.

A text is a stream of bytes, lower-cased, and one end symbol; a byte is eight binary decisions. For each
order from 0 to 4, a context (the bytes before, and the bits already known of this one) has a pair of
counters of zeros and ones, gathered from all training texts. A decision mixes the log-odds of the five
predictors in the logistic domain, with a weight set gated by the highest order that has been seen, how often,
and by the place of the bit. Weights are learnt online: the contexts are dealt into BLOCKS by their hash, and block
after block moves the weights by what it adds to slope and curvature, each prediction made without the
occurrence that it predicts. A last table adaptively refines the mixed probability.

When texts are scored, counters, weights and refinement are fixed: a text's score depends on the text and
the training texts alone, not on how tasks share the work, and equal strings of five bytes cost the same
everywhere, so each is mixed once.

The counters are an exact form of hashed ones: a table, dealt out by the hash of the context, in which every
context has a slot of its own, so that none reads another's counts; it grows with the corpus. Byte strings
are counted by a shuffle and kept as a table of one row per three bytes of context, which holds all that orders 2 to 4 have to know about its strings; a
row has at most 65,536 strings. Orders 0 and 1 have at most 65,536 counts and are handed to every task,
as are the frequent words and the bits of the frequent byte strings; the other words and strings are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from . import bytewords as bw
from .common import OncePerWorker, stored, with_text_results

ORDERS = 5
HOT_WORDS = 1 << 18  # frequent words that every task holds, 4 MB; the others are joined
HOT_STRINGS = 1 << 20  # frequent byte strings whose bits every task holds, 16 MB; the others are joined
PIECE = 1 << 20
BLOCKS = 8  # of the contexts, by their hash: the steps of online learning
BATCH = 4096  # byte strings whose predictions are made together
_INPUTS = 2 * ORDERS + 1
_SEEN = (2, 8, 64)  # occurrences of the highest order seen that part the weight sets
_GATES = ORDERS * (len(_SEEN) + 1)
_SETS = 8 * _GATES
_BINS = 25
_PRIOR = 0.3
_PAD, _END = 0xFE, 0xFF  # never in UTF-8
_END_WORD = np.uint64(0)  # stands for the end token among word hashes
_CACHE_BITS = 21


# -- streams -----------------------------------------------------------------------------------------


def byte_strings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte and end of the texts, that byte and the four before it, as one number."""
    return np.concatenate([np.zeros(0, np.uint64), *(codes for _, codes in string_pieces(data, offsets))])


def string_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, byte string) of all texts, PIECE bytes at a time, so that memory does not follow a text's length."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        for start in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), PIECE):
            stop = min(start + PIECE, int(offsets[j]))
            inside = np.clip(offsets[i : j + 1], start, stop)
            last = stop == offsets[j]
            yield _strings_in(data, inside, i, start - int(offsets[i]), last)
        i = j


def _strings_in(data: np.ndarray, offsets: np.ndarray, first: int, done: int, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Strings of texts from ``first`` on; of the first one ``done`` bytes came before, and without ``ends`` more follow."""
    n = len(offsets) - 1
    stream = np.full(offsets[-1] - offsets[0] + 5 * n, _PAD, np.uint8)
    owners = np.full(len(stream), -1)
    for k in range(n):
        size = offsets[k + 1] - offsets[k]
        at = offsets[k] - offsets[0] + 5 * k + 4
        before = min(4, done) if k == 0 else 0
        stream[at - before : at + size] = bw.LOWER[data[offsets[k] - before : offsets[k + 1]]]
        owners[at : at + size] = first + k
        if ends or k < n - 1:
            stream[at + size], owners[at + size] = _END, first + k
    wide = stream.astype(np.uint64)
    code = wide[4:].copy()
    for back in range(1, 5):
        code |= wide[4 - back : -back] << np.uint64(8 * back)
    real = owners[4:] >= 0
    return owners[4:][real], code[real]


class _Tally:
    """Counts of 64-bit keys, merged whenever many have come together."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.waiting, self.parts = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        keys, counts = self._merged(keys, counts if counts is not None else np.ones(len(keys), np.int64))
        self.parts.append((keys, counts))
        self.waiting += len(keys)

    @staticmethod
    def _merged(keys, counts):
        if not len(keys):
            return keys, counts
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def full(self) -> bool:
        """Merge if due; whether it is still full after that."""
        if self.waiting > self.most:
            self.parts = [self._merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.waiting = len(self.parts[0][0])
        return self.waiting > self.most // 2

    def take(self, kind: int) -> pa.RecordBatch:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, counts = self._merged(*(np.concatenate(x) for x in zip(empty, *self.parts, strict=True)))
        self.waiting, self.parts = 0, []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts)],
            names=["kind", "key", "n"],
        )


_WORD, _STRING, _ASKED = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts to counts of word hashes and of five-byte strings."""
    tallies = {_WORD: _Tally(), _STRING: _Tally()}
    for batch in batches:
        for i, j, data, offsets in bw.pieces(batch.column(0), PIECE):
            tallies[_WORD].add(bw.words(data, offsets, bw.BY_SPACE).hashes)
            tallies[_WORD].add(np.array([_END_WORD]), np.array([j - i]))
            for _, codes in string_pieces(data, offsets):
                tallies[_STRING].add(codes)
                for kind, tally in tallies.items():
                    if tally.full():
                        yield tally.take(kind)
    for kind, tally in tallies.items():
        yield tally.take(kind)


def _count_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to be scored to counts of their five-byte strings."""
    tally = _Tally()
    for batch in batches:
        for _, _, data, offsets in bw.pieces(batch.column(0), PIECE):
            for _, codes in string_pieces(data, offsets):
                tally.add(codes)
                if tally.full():
                    yield tally.take(_ASKED)
    yield tally.take(_ASKED)


# -- the counters ------------------------------------------------------------------------------------

_CONTEXTS = (1 << 24) - 1
_CONTEXT_ROWS = "strings array<struct<key: long, n: long, m: long>>, second array<struct<key: long, n: long>>, block long"


def context_table(strings: DataFrame) -> DataFrame:
    """One row per three bytes of context, from (key, n in training, m to be scored) of all strings.

    ``strings`` has all strings after that context, ``second`` the training counts of the bytes after its
    last two bytes.
    """
    key = F.col("key")
    rows = strings.groupBy(F.shiftright(key, 8).bitwiseAND(_CONTEXTS).alias("context")).agg(
        F.sort_array(F.collect_list(F.struct("key", "n", "m"))).alias("strings")
    )
    counts = strings.where("n > 0").groupBy(key.bitwiseAND(_CONTEXTS).alias("key")).agg(F.sum("n").alias("n"))
    second = counts.groupBy(F.shiftright(key, 8).alias("pair")).agg(
        F.sort_array(F.collect_list(F.struct("key", "n"))).alias("second")
    )
    joined = rows.withColumn("pair", F.col("context").bitwiseAND(0xFFFF)).join(second, "pair", "left")
    return joined.select("strings", "second", F.pmod(F.xxhash64("context"), F.lit(BLOCKS)).alias("block"))


def first_counts(strings: DataFrame) -> np.ndarray:
    """Training counts by a byte and the one before it: at most 65,536 rows."""
    pairs = strings.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    table, counts = pairs.toArrow(), np.zeros(1 << 16, np.int64)
    counts[table.column("key").to_numpy()] = table.column("n").to_numpy()
    return counts


def _upto(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _on_path(codes: np.ndarray, place: Callable[[np.ndarray], np.ndarray], upto: np.ndarray) -> np.ndarray:
    """For 0 to 8 leading bits of each code's last byte, the occurrences in the same context that share them.

    ``upto[place(x)]`` is the number of occurrences of codes below x.
    """
    out = np.empty((9, len(codes)), np.int64)
    for bits in range(9):
        low = codes >> (8 - bits) << (8 - bits)
        out[bits] = upto[place(low + (1 << (8 - bits)))] - upto[place(low)]
    return out


def path_counts(keys: np.ndarray, n: np.ndarray, second: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Occurrences (order, leading bits, string) on the paths of all strings of some three-byte contexts.

    ``second`` has codes of three bytes and their counts, ``first`` is that of ``first_counts``.
    """
    out = np.empty((ORDERS, 9, len(keys)), np.int64)
    zero = _upto(first.reshape(256, 256).sum(axis=0))
    out[0] = _on_path(keys & 0xFF, lambda x: x, zero)
    out[1] = _on_path(keys & 0xFFFF, lambda x: x, _upto(first))
    codes, at = np.unique(second[0], return_index=True)  # rows of the same two bytes repeat them
    out[2] = _on_path(keys & _CONTEXTS, lambda x: np.searchsorted(codes, x), _upto(second[1][at]))
    for order, mask in ((3, (1 << 32) - 1), (4, (1 << 40) - 1)):
        own = keys & mask
        by_code = np.argsort(own, kind="stable")
        ordered, upto = own[by_code], _upto(n[by_code])
        out[order] = _on_path(own, lambda x, ordered=ordered: np.searchsorted(ordered, x), upto)
    return out


def _strings_of(batches: Iterator[pa.RecordBatch], first: np.ndarray) -> Iterator[tuple]:
    """(strings, n, m, path counts) of rows of the context table, BATCH strings at most at a time."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy())])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH, "right")) - 1)
            part = batch.slice(i, j - i)
            keys, n, m = (x.to_numpy() for x in part.column(0).flatten().flatten())
            paths = path_counts(keys, n, tuple(x.to_numpy() for x in part.column(1).flatten().flatten()), first)
            for k in range(0, len(keys), BATCH):
                to = slice(k, k + BATCH)
                yield keys[to].view(np.uint64), n[to], m[to], paths[:, :, to]
            i = j


# -- the mixing model --------------------------------------------------------------------------------


def _decisions(strings: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, known leading bits, this bit) of the eight decisions of each string's last byte."""
    byte = strings & np.uint64(0xFF)
    for place in range(8):
        known = (np.uint64(1) << np.uint64(place)) | (byte >> np.uint64(8 - place))
        yield place, known, (byte >> np.uint64(7 - place)) & np.uint64(1)


@dataclass
class Mixer:
    """Weight sets, and the refinement: probability of a one by weight set and binned log-odds."""

    weights: np.ndarray  # (_SETS, _INPUTS)
    refined: np.ndarray  # (_SETS, _BINS)

    @classmethod
    def start(cls) -> Mixer:
        weights = np.zeros((_SETS, _INPUTS))
        weights[:, :ORDERS] = 0.3
        return cls(weights, np.tile(1 / (1 + np.exp(-_bin_odds())), (_SETS, 1)))


def _bin_odds() -> np.ndarray:
    return np.linspace(-9, 9, _BINS)


def _at_place(paths: np.ndarray, place: int, bit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Zeros and ones of each order's context at this decision of the strings with these path counts."""
    own = paths[:, place + 1].astype(float)
    other = paths[:, place] - own
    return [(np.where(bit == 0, a, b), np.where(bit == 1, a, b)) for a, b in zip(own, other, strict=True)]


def _inputs(counters, bit=None) -> tuple[np.ndarray, np.ndarray]:
    """Mixer inputs (rows, _INPUTS) and the gate; with ``bit``, one occurrence of it less.

    The gate is the highest order seen and how often it has been seen.
    """
    rows = len(counters[0][0])
    x, gate = np.ones((rows, _INPUTS)), np.zeros(rows, np.int64)
    for k, (a, b) in enumerate(counters):
        if bit is not None:
            a, b = np.maximum(a - (bit == 0), 0), np.maximum(b - (bit == 1), 0)
        total = a + b
        odds = np.log((b + _PRIOR) / (a + _PRIOR))
        x[:, k] = odds
        x[:, ORDERS + k] = odds * (total / (total + 4))
        some = total > 0
        gate[some] = k * (len(_SEEN) + 1) + np.searchsorted(_SEEN, total[some], "right")
    return x, gate


def _bins(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin below each log-odds, and how far it is towards the next."""
    place = (np.clip(odds, -9, 9) + 9) / 18 * (_BINS - 1)
    low = np.minimum(place.astype(np.int64), _BINS - 2)
    return low, place - low


def _probability(mixer: Mixer, x: np.ndarray, sets: np.ndarray) -> np.ndarray:
    odds = (x * mixer.weights[sets]).sum(axis=1)
    low, part = _bins(odds)
    refined = mixer.refined[sets, low] * (1 - part) + mixer.refined[sets, low + 1] * part
    mixed = 1 / (1 + np.exp(-np.clip(odds, -12, 12)))
    return np.clip((mixed + refined) / 2, 1e-6, 1 - 1e-6)


def _bits(strings: np.ndarray, counters: Callable, mixer: Mixer) -> np.ndarray:
    """Bits that the last byte of each string takes, by its ``counters(place, known, bit)``."""
    bits = np.zeros(len(strings))
    for place, known, bit in _decisions(strings):
        x, gate = _inputs(counters(place, known, bit))
        one = _probability(mixer, x, place * _GATES + gate)
        bits -= np.log2(np.where(bit == 1, one, 1 - one))
    return bits


def _mix(shared, mixer: Mixer):
    """Rows of the context table to (string, bits, occurrences) of the strings that are to be scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, _, m, paths in _strings_of(batches, shared.value):
            asked = m > 0
            strings, paths = strings[asked], paths[:, :, asked]
            bits = _bits(strings, lambda place, known, bit, paths=paths: _at_place(paths, place, bit), mixer)
            yield pa.RecordBatch.from_arrays(
                [pa.array(strings.view(np.int64)), pa.array(bits), pa.array(m[asked])], names=["key", "bits", "n"]
            )

    return run


def _numbered(sums: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(sums.ravel())
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums.ravel()[some])], names=["i", "value"])


def _slopes(shared, mixer: Mixer):
    """A part of a block: slope and curvature of its log-likelihood at these weights, by weight set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_SETS, _INPUTS + 1, _INPUTS))
        for strings, n, paths in _training(batches, shared.value):
            for place, _, bit in _decisions(strings):
                x, gate = _inputs(_at_place(paths, place, bit), bit)
                for own in np.unique(gate):
                    at = gate == own
                    k, part = place * _GATES + own, x[at]
                    one = 1 / (1 + np.exp(-np.clip(part @ mixer.weights[k], -12, 12)))
                    sums[k, :-1] += (part * (n[at] * np.maximum(one * (1 - one), 1e-3))[:, None]).T @ part
                    sums[k, -1] += part.T @ (n[at] * (bit[at].astype(float) - one))
        yield _numbered(sums)

    return run


def _refine(shared, mixer: Mixer):
    """A part of the corpus: ones and all decisions by weight set and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _SETS, _BINS))
        for strings, n, paths in _training(batches, shared.value):
            for place, _, bit in _decisions(strings):
                x, gate = _inputs(_at_place(paths, place, bit), bit)
                sets = place * _GATES + gate
                low, part = _bins((x * mixer.weights[sets]).sum(axis=1))
                for at, share in ((low, n * (1 - part)), (low + 1, n * part)):
                    np.add.at(sums[0], (sets, at), share * bit.astype(float))
                    np.add.at(sums[1], (sets, at), share)
        yield _numbered(sums)

    return run


def _training(batches: Iterator[pa.RecordBatch], first: np.ndarray) -> Iterator[tuple]:
    """(strings, n, path counts) of the training strings."""
    for strings, n, _, paths in _strings_of(batches, first):
        taught = n > 0
        yield strings[taught], n[taught].astype(float), paths[:, :, taught]


def _sums(parts: DataFrame, *shape: int) -> np.ndarray:
    """Sum of the arrays of all parts, added up by Spark: what comes here is one array."""
    out = np.zeros(int(np.prod(shape)))
    for row in parts.groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row["i"]] = row["value"]
    return out.reshape(shape)


def train_mixer(contexts: DataFrame, shared) -> Mixer:
    """Weights by one online Newton step for each block of the contexts, in a fixed order; then the refinement.

    A step goes by the block's slope at the weights so far and by the curvature of all blocks so far. Both
    are sums over the block, so they are the same however it is spread over tasks.
    """
    mixer, part = Mixer.start(), "i int, value double"
    curvature = np.tile(np.eye(_INPUTS) * 20.0, (_SETS, 1, 1))
    for block in range(BLOCKS):
        rows = contexts.where(F.col("block") == block).drop("block")
        sums = _sums(rows.mapInArrow(_slopes(shared, mixer), part), _SETS, _INPUTS + 1, _INPUTS)
        curvature += sums[:, :-1]
        mixer = Mixer(mixer.weights + np.linalg.solve(curvature, sums[:, -1, :, None])[:, :, 0], mixer.refined)
    ones, total = _sums(contexts.drop("block").mapInArrow(_refine(shared, mixer), part), 2, _SETS, _BINS)
    return Mixer(mixer.weights, (ones + 2 * mixer.refined) / (total + 2))


class _Known:
    """Bits of the frequent strings: from a table of one string per place, the others by search."""

    def __init__(self, hot):
        self.keys, self.values = hot  # ascending
        place = self._place(self.keys)
        self.strings = np.full(1 << _CACHE_BITS, 2**64 - 1, np.uint64)  # no string is that
        self.bits = np.zeros(1 << _CACHE_BITS)
        self.strings[place], self.bits[place] = self.keys, self.values

    @staticmethod
    def _place(strings: np.ndarray) -> np.ndarray:
        return ((strings * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)

    def __call__(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits, 0 where unknown, and which strings are not among the frequent ones."""
        place = self._place(strings)
        missing = np.flatnonzero(self.strings[place] != strings)
        bits, unknown = self.bits[place], np.zeros(len(strings), bool)
        bits[missing], unknown[missing] = 0.0, True
        if len(missing) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, strings[missing]), len(self.keys) - 1)
            real = self.keys[at] == strings[missing]
            bits[missing[real]] = self.values[at[real]]
            unknown[missing[real]] = False
        return bits, unknown


# -- the operator ------------------------------------------------------------------------------------

_known = OncePerWorker(_Known)
_FIELDS = (
    "row long, n_tokens long, n_known long, known_sum double, bits double, n_bytes long, rare array<long>, "
    "rare_strings array<long>"
)


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.Array:
    """The values of each of n texts; ``owners`` ascend."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))


def _score(hot, hot_strings):
    counter = [0]  # each task starts from its own copy

    def per_piece(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        first = (TaskContext.get().partitionId() << 40) + counter[0]
        counter[0] += n
        hot_words, hot_logs, end_log = hot.value
        found = bw.words(data, offsets, bw.BY_SPACE)
        text = np.repeat(np.arange(n), np.diff(found.bounds))
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, found.hashes), len(hot_words) - 1)
            known = hot_words[at] == found.hashes
            logs = np.bincount(text[known], hot_logs[at[known]], n)
        else:
            known, logs = np.zeros(len(text), bool), np.zeros(n)
        ends = 0 if end_log is None else 1
        bits, strange, owners = np.zeros(n), [], []
        for owner, codes in string_pieces(data, offsets):
            own, unknown = _known(hot_strings)(codes)
            bits += np.bincount(owner, own, n)
            strange.append(codes[unknown])
            owners.append(owner[unknown])
        return [
            pa.array(first + np.arange(n)),
            pa.array(np.diff(found.bounds) + 1),
            pa.array(np.bincount(text[known], minlength=n) + ends),
            pa.array(logs + (end_log or 0.0)),
            pa.array(bits),
            pa.array(np.diff(offsets)),
            _lists(found.hashes[~known], text[~known], n),
            _lists(np.concatenate(strange), np.concatenate(owners), n),
        ]

    return per_piece


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words or strings, ``most`` of them at most: those above a count that a histogram of counts yields."""
    level = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for row in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += row["words"]
        if held > most:
            break
        least = row["level"]
    return words.where(level >= least) if least is not None else words.limit(0)


def score_texts(docs: DataFrame, training: DataFrame, text_column: str = "text", *, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, and what two models learnt from ``training`` say.

    n_tokens counts words and one end; n_known those seen in training; train_tokens all tokens there.
    base_score is the smoothed unigram log10 probability, score the mixing model's log10 probability of the
    lower-cased bytes and the end, bits_per_byte the same in bits over the bytes of the text (of an empty
    text, over one). A null text is empty. Without training texts every token and every byte is equally
    likely. Repeated rows are rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = training.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = texts.mapInArrow(_count, "kind byte, key long, n long").unionByName(
        docs.select(text_column).mapInArrow(_count_asked, "kind byte, key long, n long")
    )
    word = F.col("kind") == _WORD
    counts = stored(
        found.groupBy(word.alias("word"), "key").agg(
            F.coalesce(F.sum(F.when(F.col("kind") != _ASKED, F.col("n"))), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(F.col("kind") == _ASKED, F.col("n"))), F.lit(0)).alias("m"),
        ),
        "counts",
    )
    words, strings = counts.where("word").select("key", "n"), counts.where("not word").select("key", "n", "m")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = words.where(F.col("key") == 0).agg(F.sum("n")).first()[0]
    frequent = _frequent(words.where("key <> 0"), HOT_WORDS).toArrow()
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot_logs = np.log10(frequent.column("n").to_numpy()[order] + 0.5)
    context = spark.sparkContext
    hot = context.broadcast((keys[order], hot_logs, None if end is None else float(np.log10(end + 0.5))))

    shared = context.broadcast(first_counts(strings))
    folder = shared_folder(spark, "contexts")
    context_table(strings).write.partitionBy("block").parquet(folder)
    contexts = spark.read.schema(_CONTEXT_ROWS).parquet(folder)
    mixer = train_mixer(contexts, shared) if total else Mixer.start()
    bits = stored(contexts.drop("block").mapInArrow(_mix(shared, mixer), "key long, bits double, n long"), "bits")
    frequent = _frequent(bits, HOT_STRINGS).toArrow()
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot_strings = context.broadcast((keys[order], frequent.column("bits").to_numpy()[order]))
    del frequent

    plain = docs.select(*[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)], F.col(text_column).alias("text"))
    scored = with_text_results(
        plain, "text", "lm", _FIELDS, _score(hot, hot_strings), keep_text=False, piece_bytes=PIECE
    )
    scored = stored(scored.select(*[F.col(f"carried_{k}") for k in range(len(carry))], "lm.*"), "scores")
    rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key")
    more = rare.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 0.5)).alias("more_sum"))
    strange = scored.select("row", F.explode("rare_strings").alias("key")).join(bits.select("key", "bits"), "key")
    more_bits = strange.groupBy("row").agg(F.sum("bits").alias("more_bits"))
    all_bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    n_known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    ends_unknown = F.col("n_tokens") - n_known
    base = (
        F.col("known_sum")
        + F.coalesce("more_sum", F.lit(0.0))
        + ends_unknown * float(np.log10(0.5))
        - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    )
    return scored.join(more, "row", "left").join(more_bits, "row", "left").select(
        *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)],
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-all_bits * float(np.log10(2))).alias("score"),
        (all_bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
