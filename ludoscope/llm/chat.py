"""Reply trees as training conversations.

Iterated self-joins double the distance that every message knows its ancestor at, which yields the
score of each root-to-leaf path in a number of joins that grows with the logarithm of the depth. Leaves
are ranked by their path's score within the tree; the chosen leaves collect their ancestors through the
same tables, and each path is formatted as one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: The control strings of the template, and the role that the loss covers.
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

_ESCAPES = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """No ``<|`` is left: every run ``<\\...|`` gets one backslash more."""
    return _ESCAPES.sub(lambda m: "<\\" + m[1] + "|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


def _role_line(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    plain = unescaped(line)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the (start, end) ranges that the loss covers, in code points."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        head, body, tail = f"{BEGIN}{_role_line(role)}\n", escaped(text), f"{END}\n"
        if role == LEARNT:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_role_of(role), unescaped(rest[: -len(END) - 1])))
    return turns


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up) of 1, 2, 4, ... messages, and (tree, node, depth, total) of all that have a root.

    Messages on a cycle, or below one, have no root.
    """
    parents = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    known = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    state = stored(
        known.select(
            "tree",
            "node",
            F.col("n").alias("up"),
            F.col("n").isNotNull().cast("long").alias("depth"),
            F.col("score").alias("total"),
        ),
        "jumps",
    )
    levels, messages = [], state.count()
    while True:
        waiting = state.where("up is not null")
        if not waiting.take(1) or 1 << len(levels) > messages:
            break
        levels.append(waiting.select("tree", "node", "up"))
        above = state.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"),
            F.col("depth").alias("more"), F.col("total").alias("plus"),
        )
        # Messages that have reached their root take no further part; the ancestor of the others is there.
        step = waiting.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree",
            "node",
            F.col("next").alias("up"),
            (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("total") + F.col("plus")).alias("total"),
        )
        state = stored(state.where("up is null").unionByName(step), "jumps")
    return levels, state.where("up is null").select("tree", "node", "depth", "total")


def _messages(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """(tree, node, parent, role, text, score), one row per message; a root's parent is null or not there."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    best = F.min(
        F.struct(
            F.col(parent).alias("parent"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            value.alias("score"),
        )
    )
    return stored(
        messages.where(F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("tree"), F.col(node).alias("node"))
        .agg(best.alias("m"))
        .select("tree", "node", "m.*")
        .withColumn("parent", F.when(F.col("parent") != F.col("node"), F.col("parent"))),
        "messages",
    )


def unrooted(
    messages: DataFrame,
    *,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
) -> DataFrame:
    """(tree, node, parent, role, text, score) of the messages that ``paths`` rejects: on a cycle or below one."""
    nodes = _messages(messages, tree, node, parent, role, text, score)
    _, reached = _levels(nodes)
    rooted = reached.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    return nodes.join(rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")


def paths(
    messages: DataFrame,
    *,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int = 1,
) -> DataFrame:
    """(tree, leaf, score, rank, turns) of the ``branches`` best root-to-leaf paths of each tree.

    A path's score is the sum of its messages' scores; equal scores go by the longer path, then the
    smaller leaf. A null role or text is empty, a null score 0, a null tree is a tree of its own. Rows
    without a node are no messages; of rows with the same tree and node the smallest (parent, role, text)
    counts. A parent that is not there, or that is the message itself, makes a root. Messages on a longer
    cycle, and those below one, are on no path; ``unrooted`` returns them. An empty table gives no rows.
    """
    nodes = _messages(messages, tree, node, parent, role, text, score)
    levels, reached = _levels(nodes)
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = reached.join(
        parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti"
    )
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("depth").desc(), "node")
    chosen = stored(
        leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches), "leaves"
    )
    walked = chosen.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        further = walked.join(jump, same).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        walked = stored(walked.unionByName(further), "walked")
    content = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = (
        walked.join(content, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        .groupBy("tree", "leaf")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("place"), "role", "text"))).alias("turns"))
    )
    named = chosen.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("total").alias("score"), "rank")
    return turns.join(named, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n"))).select(
        "tree", "leaf", "score", "rank", "turns"
    )


def formatted(found: DataFrame) -> DataFrame:
    """``paths`` as (tree, leaf, score, rank, formatted, loss), loss being (start, end) ranges in code points."""
    span = T.StructType().add("start", "long").add("end", "long")
    schema = found.drop("turns").schema.add("formatted", "string").add("loss", T.ArrayType(span))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [
                format_turns([(t["role"], t["text"]) for t in turns])
                for turns in batch.column(names.index("formatted")).to_pylist()
            ]
            loss = [[{"start": a, "end": b} for a, b in mask] for _, mask in done]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names) - 2], pa.array([t for t, _ in done], pa.string()), pa.array(loss, kind)],
                names=names,
            )

    return found.select(*names[:-2], "turns").mapInArrow(run, schema)


def digests(done: DataFrame) -> DataFrame:
    """What a reader gets back from ``formatted``: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                learnt = "".join(unescaped(text[r["start"] : r["end"]]) for r in loss)
                rows.append((len(turns), _sha(whole), len(learnt), _sha(learnt), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=out)

    out = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return done.select(F.col("tree").alias("conv_id"), "formatted", "loss").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chains(rows: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) rows, each the reply to the row before it.

    Rows of one conversation are ordered by turn, null first, then role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text"
    )
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


ORACLE = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o as (select *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') as inside from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(role) + 1 + length(inside) + 11)::bigint as formatted_chars
from o group by conv_id
"""
