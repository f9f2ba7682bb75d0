"""Row filters and final ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import in_period


def where_period(df: DataFrame, ts: str, period) -> DataFrame:
    """Rows whose date lies in the closed period."""
    return df.where(in_period(F.col(ts), period))


def where_in(df: DataFrame, c: str, values: list, keep: bool = True) -> DataFrame:
    """Rows in (or, with ``keep=False``, not in) a constant list; NULL is dropped either way."""
    hit = F.col(c).isin(values)
    return df.where(hit if keep else ~hit)


def case_predicate(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The predicate of the first rule whose condition holds; without default, NULL drops the row."""
    out = reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(*rules[0]))
    return out if default is None else out.otherwise(default)


def where_case(df: DataFrame, rules, default: Column | None = None) -> DataFrame:
    return df.where(case_predicate(rules, default))


def where_lt(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) < F.col(b))


def sort_final(df: DataFrame, *order: Column | str) -> DataFrame:
    """Ordering belongs at the very end of a report; inside a plan it has no effect."""
    return df.orderBy(*order)
