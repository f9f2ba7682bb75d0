"""Numbers: safe ratios, rounding rules, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "ratio", "clamp0", "round_half_away", "trunc_n", "nearest_int", "measure", "quadratic_score",
    "noise", "is_false", "not_enabled", "sum_if", "count_if", "count_if_nonnull", "distinct_if",
    "any_flag", "at_least", "flag", "regr",
]

WIDE = "decimal(28,10)"


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double; NULL where ``b`` is zero or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clamp0(c: Column) -> Column:
    """Negative becomes 0, NULL stays NULL (``greatest`` would skip the NULL)."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def round_half_away(c: Column, n: int) -> Column:
    """Decimal rounding, half away from zero. The detour over a wide decimal drops binary noise."""
    return F.round(c.cast(WIDE), n)


def trunc_n(c: Column, n: int) -> Column:
    """Cut after ``n`` decimals, towards zero."""
    scaled = c.cast(WIDE) * F.lit(10 ** n)
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / F.lit(10 ** n)


def nearest_int(c: Column) -> Column:
    """Double to integer, ties to even (a plain cast would truncate)."""
    return F.rint(c.cast("double")).cast("int")


def measure(c: Column, n: int = 6) -> Column:
    """A report number: rounded to ``n`` decimals, as double."""
    return round_half_away(c, n).cast("double")


def quadratic_score(x: Column, tolerance: float, weight: float = 1.0) -> Column:
    """Penalty growing with the square of what exceeds ``tolerance``; NULL in, NULL out."""
    over = x.cast("double") - F.lit(float(tolerance))
    return F.lit(float(weight)) * F.pow(clamp0(over).cast("double"), F.lit(2.0))


def noise(key: Column, low: float, high: float, seed: int = 0) -> Column:
    """Repeatable noise in [low, high): a hash of the key instead of a random draw."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit


def is_false(c: Column) -> Column:
    """True only for FALSE; NULL counts as not false."""
    return c.eqNullSafe(F.lit(False))


def not_enabled(c: Column) -> Column:
    """A 0/1 switch that is missing or not 1."""
    return c.isNull() | (c != 1)


def flag(pred: Column) -> Column:
    """1 where ``pred`` holds, else 0 (also for NULL)."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def sum_if(c: Column, pred: Column) -> Column:
    return F.sum(F.when(pred, c))


def count_if(pred: Column) -> Column:
    """Rows where ``pred`` holds. Needs one row per counted id; see ``distinct_if`` otherwise."""
    return F.count(F.when(pred, F.lit(1)))


def count_if_nonnull(c: Column, pred: Column) -> Column:
    return F.count(F.when(pred, c))


def distinct_if(c: Column, pred: Column) -> Column:
    return F.countDistinct(F.when(pred, c))


def any_flag(pred: Column) -> Column:
    """Aggregate: 1 if any row of the group matches, else 0."""
    return F.coalesce(F.max(F.when(pred, F.lit(1))), F.lit(0))


def at_least(pred: Column, n: int) -> Column:
    """Aggregate: 1 if ``n`` or more rows match, else 0."""
    return flag(count_if(pred) >= n)


def regr(kind: str, y: Column, x: Column, cond: Column) -> Column:
    """Aggregate: linear regression ``slope`` or ``intercept`` of y on x over matching rows."""
    fit = {"slope": F.regr_slope, "intercept": F.regr_intercept}[kind]
    return fit(F.when(cond, y.cast("double")), F.when(cond, x.cast("double")))
