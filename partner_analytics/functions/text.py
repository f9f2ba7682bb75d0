"""Text: concatenation, patterns, labels, small arrays of strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partner_analytics.functions.numeric import nearest_int

__all__ = [
    "concat_strict", "concat_skip", "part", "rx", "like_any", "id15", "to_array", "any_eq",
    "overlaps", "join_text", "bad_phone", "pct_text", "growth_text", "case_map",
]


def concat_strict(*cols: Column) -> Column:
    """Concatenation where one NULL makes the result NULL."""
    return F.concat(*[c.cast("string") for c in cols])


def concat_skip(*cols: Column) -> Column:
    """Concatenation that leaves NULLs out."""
    return F.concat_ws("", *[c.cast("string") for c in cols])


def part(c: Column, sep: str, i: int) -> Column:
    """The i-th piece (from 1) of ``c`` split at ``sep``; empty text where there is none."""
    return F.split_part(c, F.lit(sep), F.lit(i))


def rx(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Regular expression search anywhere in the text."""
    return c.rlike(f"(?i){pattern}" if ignore_case else pattern)


def like_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns])


def id15(c: Column) -> Column:
    """The first 15 characters: the case-sensitive core of an 18 character CRM id."""
    return F.substring(c, 1, 15)


def to_array(c: Column, sep: str) -> Column:
    """Split at a literal separator."""
    return F.split(c, re.escape(sep))


def any_eq(arr: Column, values: list) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(arr, v) for v in values])


def overlaps(arr: Column, values: list) -> Column:
    """True where the array shares a non-null element with ``values``; a NULL array gives NULL.

    ``arrays_overlap`` alone would answer NULL instead of false for arrays holding a NULL.
    """
    hit = F.coalesce(F.arrays_overlap(arr, F.array(*[F.lit(v) for v in values])), F.lit(False))
    return F.when(arr.isNotNull(), hit)


def join_text(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)


def bad_phone(c: Column, n: int = 8) -> Column:
    """Missing, empty or shorter than ``n`` characters without the outer blanks."""
    return c.isNull() | (c == "") | (F.length(F.trim(c)) < n)


def pct_text(c: Column) -> Column:
    """0.256 as ``26%``."""
    return F.concat(nearest_int(c * 100).cast("string"), F.lit("%"))


def growth_text(c: Column) -> Column:
    """Growth above 2 as ``N times``, else as ``N %`` of the growth cut to two decimals."""
    percent = F.rint(F.round(c.cast("decimal(20,2)"), 2).cast("double") * 100).cast("bigint")
    times = nearest_int(c).cast("string")
    return F.when(c > 2, F.concat(times, F.lit(" times"))).otherwise(
        F.concat(percent.cast("string"), F.lit(" %"))
    )


def case_map(c: Column, mapping: dict, default) -> Column:
    """Value to label, first match wins; for long maps join a lookup table instead."""
    out = None
    for key, label in mapping.items():
        out = F.when(c == key, F.lit(label)) if out is None else out.when(c == key, F.lit(label))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))
