"""Arithmetic whose result does not depend on the order in which tasks finish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded half-up, NULL when ``whole`` is 0."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0).cast("bigint")), digits)


# Fixed value: dollars are counted to twelve decimals, below 10**13.
MONEY = "decimal(25,12)"


def money(amount: Column) -> Column:
    """Dollars as a decimal; NULL for what is no amount: NaN, infinite, or 10**13 and more."""
    return amount.try_cast(MONEY)


def money_sum(amount: Column) -> Column:
    """Exact sum of dollars; what is no amount counts like NULL."""
    return F.try_sum(money(amount))


def exact_avg(amount: Column) -> Column:
    """Average that does not depend on the order of addition; values count to eight decimals."""
    total = F.try_sum(amount.try_cast("decimal(25,8)")).cast("double")
    return total / F.nullif(F.count(amount), F.lit(0).cast("bigint"))


def decimal_avg(amount: Column, scale: int, digits: int) -> Column:
    """Average of values with at most ``scale`` decimals, rounded half-up to ``digits``."""
    total = F.sum(amount.cast(f"decimal(18,{scale})"))
    return F.round(total / F.nullif(F.count(amount), F.lit(0).cast("bigint")), digits).cast("double")


def ratio_half_up(part: Column, whole: float, digits: int) -> Column:
    """``part / whole`` rounded half-up.

    Stays in primitive arithmetic; ``round`` on a double makes a BigDecimal for every row, which
    event-sized tables should not pay for.
    """
    scale = 10**digits
    return F.floor(part * F.lit(float(scale)) / F.lit(float(whole)) + F.lit(0.5)) / F.lit(float(scale))


def net_hundredths(price: Column, discount_pct: Column) -> Column:
    """A hundred times the price after discount, an exact decimal.

    NULL for a NULL discount and for a price that is no amount (``money``).
    """
    rest = F.lit(100).cast("decimal(11,0)") - discount_pct.cast("decimal(10,0)")
    return money(price) * rest


def net_sum(price: Column, discount_pct: Column) -> Column:
    """Sum of prices after discount in dollars, independent of the order of addition."""
    return (F.try_sum(net_hundredths(price, discount_pct)) / F.lit(100)).cast("double")


def net_price(price: Column, discount_pct: Column, digits: int) -> Column:
    """Price after discount in dollars, rounded half-up."""
    return F.round(net_hundredths(price, discount_pct) / F.lit(100), digits).cast("double")


def log_or_zero(amount: Column) -> Column:
    return F.when(amount > 0, F.ln(amount)).otherwise(F.lit(0.0))
