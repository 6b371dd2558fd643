"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected addresses, give each character a
probability after up to ORDER characters, smoothed by Witten-Bell interpolation down to order 0. An
address is the whole url, from the scheme to the fragment, its digits as 0. It is judged by the difference
of its log-likelihoods per character against a threshold calibrated on labelled addresses that were left
out of the models. The rules label the addresses. Everything is DataFrame operations: each distinct string
of ORDER + 1 characters is scored once, by joins from the lowest order up, and addresses sum the scores
of their strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, computed_once, stored

ORDER = 4
BINS = 1000  # on either side of 0, in hundredths, for the threshold
SCALE = 10**9  # log-likelihoods are summed as whole billionths, so that the order of addition is no matter
_START, _END = "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: Fixed values.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def host_of(url: str) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _longest(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """Struct of the longest fitting rule, or null."""
    fitting = [
        F.when(rule.fits(host, path), F.struct(F.lit(len(rule.name)), F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow")))
        for rule in rules
    ]
    return F.array_max(F.array_compact(F.array(*fitting)))


def _strings(address: str) -> Column:
    """All strings of ORDER + 1 characters of an address between its marks, the last ending it.

    The address is taken apart once, so that the work follows its length.
    """
    padded = F.concat(F.lit(_START * ORDER), F.col(address), F.lit(_END))

    def strings(letters: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(letters) - ORDER - 1)
        return F.transform(places, lambda i: F.concat(*[F.get(letters, i + k) for k in range(ORDER + 1)]))

    return computed_once(F.regexp_extract_all(padded, F.lit("(?s)(.)"), F.lit(1)), strings)


def _string_scores(strings: DataFrame) -> DataFrame:
    """(string, score) from (string, good, bad) counts: log-odds of the last character, in billionths."""
    levels = [strings.select(F.col("string").alias("gram"), "good", "bad")]
    for _ in range(ORDER):
        shorter = F.expr("substring(gram, 2)")
        levels.append(
            stored(levels[-1].groupBy(shorter.alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
        )
    letters = levels[-1].count()
    below = None
    for level in reversed(levels):
        context = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
        sums = level.groupBy(context).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("good", "bad")], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("good", "bad")]
        )
        rows = level.withColumn("context", context).join(sums, "context")
        if below is None:
            rows = rows.withColumns({"low_good": F.lit(1.0 / max(letters, 1)), "low_bad": F.lit(1.0 / max(letters, 1))})
        else:
            rows = rows.withColumn("shorter", F.expr("substring(gram, 2)")).join(
                below.select(F.col("gram").alias("shorter"), F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad")),
                "shorter",
            )
        smoothed = {
            f"p_{c}": F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"t_{c}") * F.col(f"low_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")),
            ).otherwise(F.col(f"low_{c}"))
            for c in ("good", "bad")
        }
        below = rows.select("gram", *[p.alias(n) for n, p in smoothed.items()])
    score = F.round(F.log(F.col("p_good") / F.col("p_bad")) * SCALE).cast("long")
    return below.select(F.col("gram").alias("string"), score.alias("score"))


def _threshold(scores: DataFrame) -> DataFrame:
    """One row: the score from which an address is accepted, by the best balanced accuracy.

    Without left-out addresses of both kinds it is 0. Equal accuracies go to the threshold nearest 0.
    """
    place = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(BINS)), F.lit(-BINS)).alias("bin")
    bins = scores.groupBy(place).agg(F.sum("test_good").alias("good"), F.sum("test_bad").alias("bad"))  # 2 * BINS + 1 rows at most
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    won = (
        1 - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(everything)
        + F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(everything)
    )
    both = (F.sum("good").over(everything) > 0) & (F.sum("bad").over(everything) > 0)
    ranked = bins.select("bin", F.when(both, won).alias("won"))
    best = F.max(F.struct("won", -F.abs("bin"), F.col("bin").alias("bin")))
    return ranked.where("won is not null").agg((F.coalesce(best["bin"], F.lit(0)) / 100).alias("threshold"))


def judge_urls(pages: DataFrame, url_column: str = "url", id_column: str = "page_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages``' id and url with host, path, rule, verdict and score.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule
    decides, all others by the models, which see the whole url with its digits as 0. A null url is an empty
    one. A url without ``://`` has an empty host and path and is judged by the models alone. A fifth of the
    addresses, by crc32, is left out of the models and calibrates the threshold. Without labelled
    addresses every score is 0 and accepted. Repeated rows and null ids are rows; extra columns are ignored.
    """
    host, path = host_of(url_column), path_of(url_column)
    split = pages.select(F.col(id_column), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("by_rule", _longest(rules, F.col("host"), F.col("path"))).withColumn(
        "address", F.translate(F.coalesce("url", F.lit("")), "123456789", "000000000")
    )
    left_out = F.crc32(F.col("address").cast("binary")) % 5 == 0
    counted = {
        f"{kind}_{label}": F.count_if(chosen & (F.col("by_rule.allow") == allow))
        for kind, chosen in (("train", ~left_out), ("test", left_out))
        for label, allow in (("good", True), ("bad", False))
    }
    grouped = ruled.groupBy("address").agg(*[c.alias(n) for n, c in counted.items()])
    # Strings carry a number in place of their address, which may be long.
    addresses = stored(grouped.withColumn("number", F.monotonically_increasing_id()), "addresses")
    exploded = addresses.select("number", "train_good", "train_bad", F.explode(_strings("address")).alias("string"))
    strings = stored(
        exploded.groupBy("string").agg(F.sum("train_good").alias("good"), F.sum("train_bad").alias("bad")), "strings"
    )
    by_string = stored(_string_scores(strings), "string-scores")
    sums = (
        exploded.select("number", "string")
        .join(by_string, "string")
        .groupBy("number")
        .agg((F.sum("score") / F.count("*") / SCALE).alias("score"))
    )
    scores = stored(addresses.join(sums, "number"), "scores")
    judged = scores.crossJoin(F.broadcast(_threshold(scores))).select(  # one row
        "address", "score", (F.col("score") >= F.col("threshold")).alias("accepted")
    )
    allowed = F.coalesce(F.col("by_rule.allow"), F.col("accepted"))
    return ruled.join(judged, "address").select(
        id_column,
        "url",
        "host",
        "path",
        F.col("by_rule.name").alias("rule"),
        F.when(allowed, "allow").otherwise("block").alias("verdict"),
        "score",
    )
