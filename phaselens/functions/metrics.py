"""Exact, order-independent metric helpers.

Rates, means and declines are computed as exact rationals and rounded
half-up once, at the end. Sums run on LONG or DECIMAL, so a result never
depends on how rows were partitioned or in which order they were merged
(double sums do), and two engines that follow the same rule agree to the
last bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)
EXACT = DecimalType(38, 12)  # a value at full precision, before any rounding
_NUM = DecimalType(38, 18)  # numerator of a quotient: 20 integer digits
_DEN = DecimalType(20, 0)  # denominator: any LONG


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def yn_flag(col, yes: str = "Y") -> Column:
    """'Y'/'N' text to a non-null boolean (NULL or any other code -> False)."""
    return F.coalesce(_c(col) == F.lit(yes), F.lit(False))


def ratio(num, den, digits: int = 2, scale: int = 1) -> Column:
    """round_half_up(num * scale / den, digits) as DOUBLE; NULL if den is 0/NULL.

    ``num`` is integral or DECIMAL, ``den`` integral. The quotient is taken
    in DECIMAL(38,18) so the single rounding step is exact for any practical
    input."""
    q = F.try_divide(_c(num).cast(_NUM), _c(den).cast(_DEN))
    if scale != 1:
        q = q * F.lit(scale).cast(DecimalType(len(str(abs(scale))), 0))
    return F.round(q, digits).cast("double")


def pct(num, den, digits: int = 2) -> Column:
    """Percentage ``num / den * 100`` rounded half-up."""
    return ratio(num, den, digits, scale=100)


def exact_mean(col, digits: int = 2, in_scale: int | None = None) -> Column:
    """Mean of non-null values, rounded half-up once (pandas ``mean``, SQL
    ``AVG``): the values are summed as DECIMAL(38,12), unrounded.

    ``in_scale`` is for columns whose type bounds their decimals (money,
    integer minutes): they are summed as LONG counts of that unit."""
    c = _c(col)
    if in_scale is None:
        return ratio(F.sum(c.cast(EXACT)), F.count(c), digits)
    return ratio(scaled_sum(c, in_scale), F.count(c) * F.lit(10 ** in_scale), digits)


def scaled(col, in_scale: int = 2) -> Column:
    """A value with at most ``in_scale`` decimals as an exact LONG count of
    its smallest unit (cents for money). LONG sums stay in whole-stage
    codegen; DECIMAL sums wider than 18 digits fall back to BigDecimal."""
    return F.round(_c(col) * F.lit(10 ** in_scale)).cast("long")


def scaled_sum(col, in_scale: int = 2) -> Column:
    return F.sum(scaled(col, in_scale))


def cents_to_money(col, in_scale: int = 2, digits: int = 2) -> Column:
    """Exact DECIMAL(18,digits) from a LONG count of 10^-in_scale units,
    rounded half-up."""
    q = _c(col).cast(DecimalType(20, 0)) / F.lit(10 ** in_scale).cast(DecimalType(in_scale + 1, 0))
    return F.round(q, digits).cast(DecimalType(18, digits))


def round_double(col, digits: int = 2) -> Column:
    """Round a DOUBLE that is not an exact rational of ours (an interpolated
    quantile, a mean of means, a standard deviation) half-up, through
    DECIMAL(38,10): rounding the decimal text, not the binary value, so
    100.015 -> 100.02 regardless of its binary representation."""
    return F.round(_c(col).cast(DecimalType(38, 10)), digits).cast("double")


def money_total(col, digits: int = 2, in_scale: int = 2) -> Column:
    """Exact total of a money column (LONG cents), rounded half-up, DOUBLE."""
    return ratio(scaled_sum(col, in_scale), F.lit(10 ** in_scale), digits)


def round_money(col, digits: int = 2) -> Column:
    """Round an exact DECIMAL half-up and hand it out as DOUBLE."""
    return F.round(_c(col), digits).cast("double")


def decline_pct(pre, cur, pre_months: int = 1, cur_months: int = 1, digits: int = 2) -> Column:
    """``(pre/pm - cur/cm) / (pre/pm) * 100`` as one exact rational.

    With months = 1 this is the plain decline of two totals; with phase
    months it compares monthly means. NULL when ``pre`` is 0."""
    pre, cur = _c(pre), _c(cur)
    num = pre * F.lit(cur_months) - cur * F.lit(pre_months)
    den = pre * F.lit(cur_months)
    return ratio(num, den, digits, scale=100)


def monthly_mean(total, months: int, digits: int = 1) -> Column:
    return ratio(total, F.lit(months), digits)
