"""Named bands over a measure. The limits and names are fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, lowest price, highest price), both ends included.
PRICE_BANDS = (
    ("free", 0.0, 0.0),
    ("cheap", 0.01, 9.99),
    ("medium", 10.00, 29.99),
    ("premium", 30.00, 59.99),
)
AAA_ABOVE = 60.0

# Fixed values: (name, lowest score).
POPULARITY_BANDS = (("superstar", 100), ("hit", 70), ("mid", 40), ("niche", 10))
POPULARITY_TIERS = tuple(name for name, _ in POPULARITY_BANDS) + ("unknown",)

# Fixed values: (name, lowest review score); the top label also needs this many reviews.
REVIEW_BANDS = (
    ("very_positive", 85),
    ("mostly_positive", 70),
    ("mixed", 40),
    ("mostly_negative", 20),
)
OVERWHELMING_SCORE, OVERWHELMING_REVIEWS = 95, 500


def _at_least(value: Column, bands, otherwise: str, first: Column | None = None) -> Column:
    chain = first if first is not None else F
    for name, lowest in bands:
        chain = chain.when(value >= lowest, name)
    return chain.otherwise(otherwise)


def price_tier(price: Column) -> Column:
    """Prices outside every band (negative, NULL, 9.995, exactly 60) are ``unknown``."""
    chain = F
    for name, low, high in PRICE_BANDS:
        chain = chain.when(price.between(low, high), name)
    return chain.when(price > AAA_ABOVE, "aaa").otherwise("unknown")


def review_label(score: Column, num_reviews: Column) -> Column:
    overwhelming = (score >= OVERWHELMING_SCORE) & (num_reviews >= OVERWHELMING_REVIEWS)
    start = F.when(score.isNull(), "no_reviews").when(overwhelming, "overwhelmingly_positive")
    return _at_least(score, REVIEW_BANDS, "very_negative", start)


def popularity_tier(score: Column) -> Column:
    return _at_least(score, POPULARITY_BANDS, "unknown")
