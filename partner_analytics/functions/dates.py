"""Dates: truncation, ISO keys, durations, buckets, zones."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_of", "period_start", "shift", "whole_days", "minutes_between", "half_hour",
    "iso_week_key", "iso_month_key", "week_key", "close_second", "shift_zone", "in_period",
]


def as_of(day: date) -> Column:
    """The report clock as a literal; no operator reads the wall clock."""
    return F.lit(day)


def in_period(ts: Column, period) -> Column:
    """Inclusive date range with literal bounds, which Catalyst pushes to the scan."""
    return F.to_date(ts).between(F.lit(period.start), F.lit(period.end))


def period_start(c: Column, grain: str) -> Column:
    """First day of the month or ISO week (Monday) of ``c``."""
    return F.trunc(F.to_date(c), {"month": "MM", "week": "week"}[grain])


def shift(c: Column, n: int, unit: str) -> Column:
    """Move a date by days, weeks or months (months clamp to the month end)."""
    day = F.to_date(c)
    if unit == "day":
        return F.date_add(day, n)
    if unit == "week":
        return F.date_add(day, 7 * n)
    if unit == "month":
        return F.add_months(day, n)
    raise ValueError(f"unknown unit {unit!r}")


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from ``b`` to ``a``, exact to the microsecond."""
    micros = F.timestamp_diff("MICROSECOND", b, a)
    return micros / F.lit(60_000_000.0)


def whole_days(a: Column, b: Column) -> Column:
    """Complete 24 hour spans from ``b`` to ``a``, cut towards zero."""
    return F.timestamp_diff("DAY", b, a)


def half_hour(ts: Column) -> Column:
    """Hour plus .5 steps, nearest half hour; minute 15 and 45 round to the even side."""
    return F.hour(ts) + F.lit(0.5) * F.rint(F.minute(ts) / F.lit(30.0))


def _iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), F.to_date(c)).cast("string")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def iso_week_key(c: Column) -> Column:
    """ISO year and ISO week, as 2020-53."""
    return F.concat(_iso_year(c), F.lit("-"), _two(F.weekofyear(F.to_date(c))))


def iso_month_key(c: Column) -> Column:
    """ISO year with the calendar month: 2018-12-31 gives 2019-12. Kept for matching old keys."""
    return F.concat(_iso_year(c), F.lit("-"), _two(F.month(F.to_date(c))))


def week_key(c: Column, style: str) -> Column:
    """Period keys of mixed styles found side by side in stored reports.

    ``year-month`` and ``year-week`` use the calendar year, ``iso-month`` and ``iso-week`` the ISO
    year, ``iso-sevenday`` numbers weeks in blocks of seven days from 1 January.
    """
    day = F.to_date(c)
    if style == "year-month":
        return F.date_format(day, "yyyy-MM")
    if style == "year-week":
        return F.concat(F.year(day).cast("string"), F.lit("-"), _two(F.weekofyear(day)))
    if style == "iso-month":
        return iso_month_key(c)
    if style == "iso-week":
        return iso_week_key(c)
    if style == "iso-sevenday":
        block = F.ceil(F.dayofyear(day) / F.lit(7.0))
        return F.concat(_iso_year(c), F.lit("-"), _two(block))
    raise ValueError(f"unknown style {style!r}")


def close_second(c: Column) -> Column:
    """Closing time in seconds of the day; midnight counts as 23:59."""
    return F.when(c == 0, F.lit(86340)).otherwise(c)


def shift_zone(ts: Column, source: str, target: str) -> Column:
    """Wall clock of ``source`` read as wall clock of ``target``."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts)
