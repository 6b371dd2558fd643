"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams. The index holds, for every trigram
that some query asks for, the documents it occurs in; postings are intersected document by document, and
a rule's expression runs only on the documents its query leaves. A rule whose expression forces no
trigram runs on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as bw
from .common import stored, unused
from .trigrams import query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters, with the ``tail`` behind each."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    tail: str = ""
    span: int = 0  # group that the span starts with

    @property
    def query(self):
        return query_of(self.pattern, self.flags)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for match in re.compile(self.pattern, self.flags).finditer(text):
            if match.end(self.group) - match.start(self.group) >= self.least:
                yield match.start(self.span), re.compile(self.tail).match(text, match.end()).end()


#: A key behind its BEGIN line: all up to the END line if that is the next marker; else header lines and Base64
#: lines, whole or in runs of 16 and more, and the shorter run that ends them. Line breaks may be escaped,
#: lines quoted or indented.
_BETWEEN = r"""(?:\s|\\+[nrt]|(?://|\+)(?=\s)|[>#"'|*,])"""
_KEY = (
    r"(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:(?:{_BETWEEN}++[A-Z][A-Za-z-]*:\x20[^\r\n\\]*+)*+"
    rf"(?:{_BETWEEN}*+[A-Za-z0-9+/=]{{16,}}+|(?:\s*[\r\n]|\\+n){_BETWEEN}*+[A-Za-z0-9+/=]++(?=[\x20\t\x22',]*(?:[\r\n\\]|\Z)))++"
    rf"(?:{_BETWEEN}++[A-Za-z0-9+/=]+)?)?"
)

#: The base rules, then what is found beyond them, in the order of their listing.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule(
        "url_login",
        # The scheme is looked for once in each run of its characters, so that long runs cost no more.
        r"(?<![A-Za-z0-9+.-])[0-9+.-]*([A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:[^\s/:@]+@)",
        span=1,
    ),
)
RULES = BASE + MORE

_SPAN = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
_SPANS = T.ArrayType(_SPAN)


def _index(trigrams: list[bytes]):
    """(key, text) to its postings (key, number of the trigram), for the trigrams asked for."""
    codes = np.array([int.from_bytes(t, "big") for t in trigrams], np.int64)
    pairs = np.zeros(1 << 16, bool)
    pairs[codes >> 8] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, data, offsets in bw.pieces(batch.column(1)):
                low = bw.LOWER[data].astype(np.uint16)
                at = np.flatnonzero(pairs[(low[:-2] << 8) | low[1:-1]]) if len(low) > 2 else np.zeros(0, np.int64)
                code = (low[at].astype(np.int64) << 16) | (low[at + 1].astype(np.int64) << 8) | low[at + 2]
                number = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                owner = np.searchsorted(offsets, at, "right") - 1
                real = (codes[number] == code) & (at + 2 < offsets[owner + 1])
                found = np.unique(owner[real] * len(codes) + number[real])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i + found // len(codes)]), pa.array((found % len(codes)).astype(np.int32))],
                    names=["key", "trigram"],
                )

    return run


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for the (key, text) rows, the numbers of the rules whose trigram query holds."""
    queries = {n: rule.query for n, rule in enumerate(rules) if rule.query}
    trigrams = sorted(set().union(*[trigrams_of(q) for q in queries.values()]))
    if not trigrams:
        return texts.sparkSession.createDataFrame([], "key long, rules array<int>")
    number = {t: n for n, t in enumerate(trigrams)}
    postings = texts.select("key", "text").mapInArrow(_index(trigrams), "key long, trigram int")
    present = postings.groupBy("key").agg(F.collect_set("trigram").alias("present"))

    def holds(query) -> Column:
        clauses = [
            reduce(
                Column.__or__,
                [
                    F.size(F.array_intersect("present", F.array(*[F.lit(number[t]) for t in sorted(alternative)])))
                    == len(alternative)
                    for alternative in clause
                ],
            )
            for clause in query
        ]
        return reduce(Column.__and__, clauses)

    holding = F.array_compact(F.array(*[F.when(holds(q), F.lit(n)) for n, q in queries.items()]))
    return present.select("key", holding.alias("rules")).where(F.size("rules") > 0)


def _verify(rules: tuple[Rule, ...], text: int, chosen: int, kept: list[int], schema: T.StructType, mask: str | None):
    always = [n for n, rule in enumerate(rules) if not rule.query]

    def scanned(value: str, numbers: list[int] | None) -> list[dict]:
        found = [
            (start, n, end) for n in sorted({*always, *(numbers or ())}) for start, end in rules[n].spans(value)
        ]
        return [{"kind": rules[n].kind, "start": start, "end": end} for start, n, end in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = [scanned(t or "", r) for t, r in zip(texts, batch.column(chosen).to_pylist(), strict=True)]
            arrays = []
            for k in kept:
                if k == text and mask is not None and any(spans):
                    masked = [masked_text(t, s, mask) if s else t for t, s in zip(texts, spans, strict=True)]
                    arrays.append(pa.array(masked, batch.column(k).type))
                else:
                    arrays.append(batch.column(k))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind)], names=schema.names)

    return run


def masked_text(text: str, spans: list[dict], mask: str) -> str:
    """``text`` with every run of overlapping or touching spans replaced by ``mask``."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at and not (out and span["start"] == at):
            out += [text[at : span["start"]], mask]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    rules: tuple[Rule, ...] = RULES,
    keep_text: bool = True,
    mask: str | None = None,
) -> tuple[DataFrame, str]:
    """``docs`` with an array of (kind, start, end), by start and then by rule; and that column's name.

    Offsets count code points, ends are exclusive; matches of one rule do not overlap, those of different
    rules may. A null text has no spans, and stays null. With ``mask`` the spans in the text are replaced
    by it. Null ids, repeated rows, extra and equally named columns make no difference.
    """
    key, chosen = unused(docs.columns, "key"), unused(docs.columns, "chosen")
    name = unused([*docs.columns, key, chosen], "spans")
    keyed = docs.withColumn(key, F.xxhash64(id_column, text_column))
    found = stored(
        candidates(keyed.select(F.col(key).alias("key"), F.col(text_column).alias("text")), rules), "candidates"
    ).select(F.col("key").alias(key), F.col("rules").alias(chosen))
    joined = keyed.join(found, key, "left").select(*docs.columns, chosen)
    text = docs.columns.index(text_column)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text]
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField(name, _SPANS)])
    return joined.mapInArrow(_verify(rules, text, len(docs.columns), kept, schema, mask), schema), name


def n_spans(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined_spans(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, of the given kinds only, joined by commas."""
    column = F.col(spans)
    if kinds:
        column = F.filter(column, lambda x: x["kind"].isin(*kinds))
    return F.array_join(
        F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )
