"""Quality rules with cross-document line frequency, in DataFrame operations alone.

Every line is normalised and hashed. A line that too many distinct documents of one host share is taken
out, and a document that this depletes is rejected, like one that breaks a rule about its words. What is
taken out depends on a document's host and text alone, so equal documents of a host are one content and
are worked on once. Lines that are a noticeable share of all lines are few, by that share, and are
broadcast; the others are joined, and none of them makes a large key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once, stored, unused

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words of a repeated passage
FEWEST_WORDS, MOST_REPEATED = 10, 20  # a document's words, and per cent of them in repeated passages
MOST_DOCUMENTS, MOST_SHARE = 20, 0.001  # documents of a host that may share a line, and of all its documents
LEAST_LEFT = 0.2  # of a document's characters
HEAVY = 10_000  # a line with more than this part of all lines is heavy, so there are fewer heavy lines


def _n_without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, "")).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice: equal hashes are neighbours once they are sorted."""

    def places(found: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            same = (F.get(found, i - 1)["hash"] == x["hash"]) | (F.get(found, i + 1)["hash"] == x["hash"])
            return F.when(same, x["at"])

        return F.sort_array(F.array_compact(F.transform(found, repeated)))

    def words(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: n + step)

    found = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
    return computed_once(computed_once(found, places), words)


def _word_counts(text: Column) -> Column:
    """Struct of n_words and n_repeat_words."""

    def counts(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        windows = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        repeated = computed_once(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w)),
        )
        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            F.when(F.size(hashes) > WINDOW, repeated).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return computed_once(F.transform(words, lambda w: F.xxhash64(w)), counts)


def _line_counts(text: Column) -> Column:
    """Struct of n_dup_lines and of the lines with a word as (hash, chars, at)."""

    def counts(lines: Column) -> Column:
        worded = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        distinct = F.transform(lines, lambda line, at: F.struct(_line_hash(line), _n_without(line, SPACES).alias("chars"), at.alias("at")))
        return F.struct(
            computed_once(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.filter(distinct, lambda line: line["chars"] > 0).alias("lines"),
        )

    return computed_once(F.split(text, "\n"), counts)


def _line_hash(line: Column) -> Column:
    """Of the line in lower case, all digits alike, without punctuation, runs of spaces as one."""
    plain = F.translate(F.lower(line), "123456789.,;:!?'\"()[]-", "000000000")
    return F.xxhash64(F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))).alias("hash")


def _content(host_column: str, text: Column) -> Column:
    host = F.col(host_column)
    return F.xxhash64(host.isNull(), host.cast("string"), text)


def frequent_lines(
    contents: DataFrame, *, most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE
) -> DataFrame:
    """(line, n_documents) of the lines above the limits; ``line`` is a hash of host and line.

    ``contents`` are (content, host, lines), one row per distinct document of a host.
    """
    counted = (
        contents.select("host", F.explode(_distinct_lines()).alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count("*").alias("n_documents"))
    )
    often = counted.where(F.col("n_documents") > most_documents)
    hosts = contents.groupBy("host").agg((F.count("*") * F.lit(float(most_share))).alias("limit"))
    above = often.join(hosts, "host").where(F.col("n_documents") > F.col("limit"))
    return above.select(F.xxhash64("host", "hash").alias("line"), "n_documents")


def _distinct_lines() -> Column:
    return F.array_distinct(F.transform("lines", lambda line: line["hash"]))


def _removed(contents: DataFrame, frequent: DataFrame) -> DataFrame:
    """(content, removed_chars, removed): the characters of frequent lines and these lines' places."""
    lines = contents.select("content", "host", F.explode("lines").alias("one")).select(
        "content", F.xxhash64("host", "one.hash").alias("line"), "one.chars", "one.at"
    )
    n_lines = contents.agg(F.sum(F.size(_distinct_lines()))).first()[0] or 0
    heavy = F.col("n_documents") * HEAVY > n_lines
    found = [
        lines.join(F.broadcast(frequent.where(heavy).select("line")), "line", "left_semi"),
        lines.join(frequent.where(~heavy).select("line"), "line", "left_semi"),
    ]
    return found[0].unionByName(found[1]).groupBy("content").agg(
        F.sum("chars").alias("removed_chars"), F.array_sort(F.collect_list("at")).alias("removed")
    )


def _digest(docs: DataFrame, keep: list[Column], text_column: str, host_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        *keep,
        _content(host_column, text).alias("content"),
        F.xxhash64(F.col(host_column).isNull(), F.col(host_column).cast("string")).alias("host"),
        _n_without(text, SPACES).alias("word_chars"),
        (F.length(text) - _n_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        _word_counts(text).alias("words"),
        _line_counts(text).alias("lines"),
    )


def _removals(digest: DataFrame, limits: dict) -> DataFrame:
    """(content, removed_chars, removed) of the contents that lose lines."""
    one = digest.select("content", "host", "lines.lines").dropDuplicates(["content"])
    contents = stored(one, "contents")
    return stored(_removed(contents, stored(frequent_lines(contents, **limits), "frequent")), "removed")


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    *,
    fewest_words: int = FEWEST_WORDS,
    most_repeated: int = MOST_REPEATED,
    least_left: float = LEAST_LEFT,
    **limits,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_chars, base_failed, kept).

    ``base_failed`` marks fewer than ``fewest_words`` words, or more than ``most_repeated`` per cent of them
    in repeated passages of five words. A line goes if more than ``most_documents`` distinct documents of
    its host have it, and more than ``most_share`` of the host's documents (``frequent_lines``); a document
    is depleted, and not kept, if less than ``least_left`` of its characters in words is left.

    A null text is an empty text, without words and so never kept. Null hosts are one host. Equal texts of
    one host count as one document, and each row gets its verdict, so repeated rows are all returned. Null
    ids are ids. An empty table gives no rows; other columns, of any name, are ignored.
    """
    digest = stored(_digest(docs, [F.col(id_column).alias("id")], text_column, host_column), "digest")
    removed = _removals(digest, limits).select("content", "removed_chars")
    n_words, repeated = F.col("words.n_words"), F.col("words.n_repeat_words")
    lost = F.coalesce("removed_chars", F.lit(0)).cast("long")
    failed = (n_words < fewest_words) | (100 * repeated > most_repeated * n_words)
    depleted = F.col("word_chars") - lost < F.col("word_chars") * F.lit(float(least_left))
    return digest.join(removed, "content", "left").select(
        "id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n_dup_lines").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        lost.alias("removed_chars"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
    )


def without_frequent_lines(
    docs: DataFrame, text_column: str = "text", host_column: str = "source", **limits
) -> DataFrame:
    """``docs`` with the lines above the limits taken out of their texts, all rows and columns as they were.

    Rows and limits as in ``quality_rules``. A text that loses no line stays byte for byte, a null text null.
    """
    content = unused(docs.columns, "content")
    text = F.coalesce(F.col(text_column), F.lit(""))
    removed = _removals(_digest(docs, [], text_column, host_column), limits)
    places = removed.select(F.col("content").alias(content), F.col("removed").alias(f"{content}_removed"))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), f"{content}_removed")
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    stripped = F.when(F.col(f"{content}_removed").isNull(), F.col(text_column)).otherwise(computed_once(F.split(text, "\n"), rest))
    return (
        docs.withColumn(content, _content(host_column, text))
        .join(places, content, "left")
        .withColumn(text_column, stripped)
        .select(*[f"`{c}`" for c in docs.columns])
    )
