"""Reporting periods, computed on the driver from an explicit as-of date.

Bounds become literals in the plan, so date filters reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Period:
    """Closed date interval; ``label`` is the report key of the period."""

    start: date
    end: date
    label: str

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def month_start(day: date, back: int = 0) -> date:
    index = day.year * 12 + day.month - 1 - back
    return date(index // 12, index % 12 + 1, 1)


def week_start(day: date, back: int = 0) -> date:
    return day - timedelta(days=day.weekday() + 7 * back)


def iso_week(day: date) -> str:
    year, week, _ = day.isocalendar()
    return f"{year:04d}-{week:02d}"


def previous_month(as_of: date) -> Period:
    start = month_start(as_of, 1)
    return Period(start, month_start(as_of) - timedelta(days=1), f"{start:%Y-%m}")


def previous_week(as_of: date) -> Period:
    start = week_start(as_of, 1)
    return Period(start, start + timedelta(days=6), iso_week(start))


def last_weeks(as_of: date, weeks: int) -> Period:
    """The ``weeks`` full ISO weeks before the week of ``as_of``."""
    start = week_start(as_of, weeks)
    return Period(start, week_start(as_of) - timedelta(days=1), f"{iso_week(start)}+{weeks}")


def fixed(start: date, end: date) -> Period:
    return Period(start, end, f"{start:%Y-%m}")


def period(as_of: date, grain: str, n: int = 1) -> Period:
    """``grain`` is ``month`` (previous month), ``week`` (previous week) or ``weeks`` (``n`` back)."""
    if grain == "month":
        return previous_month(as_of)
    if grain == "week":
        return previous_week(as_of)
    if grain == "weeks":
        return last_weeks(as_of, n)
    raise ValueError(f"unknown grain {grain!r}")


def minus_months(day: date, months: int) -> date:
    """Calendar month arithmetic, clamped to the last day of the month."""
    first = month_start(day, months)
    last = month_start(first, -1) - timedelta(days=1)
    return first.replace(day=min(day.day, last.day))
