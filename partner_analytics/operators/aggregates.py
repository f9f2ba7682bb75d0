"""Aggregations. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: list, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])


def distinct_counts(df: DataFrame, keys: list[str], counted: str | Column, conditions: dict[str, Column]) -> DataFrame:
    """Many filtered distinct counts of one column or expression in one pass.

    Rows first shrink to one per value with a 0/1 mark per condition, then marks are summed; the
    direct form would expand every row once per count. NULL is not counted, and a group without any
    value keeps its row of zeros.
    """
    value = F.col(counted) if isinstance(counted, str) else counted
    marks = df.withColumn("_counted", value).groupBy(*keys, "_counted").agg(
        *[F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in conditions.items()])
    known = F.col("_counted").isNotNull()
    return marks.groupBy(*keys).agg(*[F.sum(F.when(known, F.col(name)).otherwise(0)).alias(name) for name in conditions])


def having(df: DataFrame, keys: list[str], measure: Column, name: str, minimum) -> DataFrame:
    """Groups whose measure exceeds ``minimum``."""
    return df.groupBy(*keys).agg(measure.alias(name)).where(F.col(name) > minimum)


def rollup_max(df: DataFrame, inner: list, outer: list, columns: list[str]) -> DataFrame:
    """Maximum per fine group, then spread as maximum of the wider group to every fine group."""
    fine = df.groupBy(*dict.fromkeys([*outer, *inner])).agg(*[F.max(c).alias(c) for c in columns])
    wide = fine.groupBy(*outer).agg(*[F.max(c).alias(c) for c in columns])
    return fine.drop(*columns).join(wide, outer)


def with_group(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Group totals on every row: an aggregation joined back, so no group sits in one task."""
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])
    renamed = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *measures)
    cond = None
    for k in keys:
        same = df[k].eqNullSafe(renamed[f"_{k}"])
        cond = same if cond is None else cond & same
    return df.join(renamed, cond).drop(*[f"_{k}" for k in keys])


def pivot_ranked(df: DataFrame, keys: list[str], rank: str, columns: dict[str, str], k: int,
                 totals: list[Column] = ()) -> DataFrame:
    """Ranks 1..k of every group as text columns ``<prefix>_1 .. _k``; a missing rank gives ''."""
    cells = [
        F.coalesce(F.max(F.when(F.col(rank) == i, F.col(c).cast("string"))), F.lit("")).alias(f"{prefix}_{i}")
        for c, prefix in columns.items() for i in range(1, k + 1)
    ]
    return df.groupBy(*keys).agg(*cells, *totals)


def period_pivot(df: DataFrame, keys: list[str], day: str, start, weeks: int, kpis: dict[str, tuple[str, Column]],
                 totals: list[Column] = ()) -> DataFrame:
    """Each KPI in total and per week as ``name``, ``name_w_1`` .. in one pass over the rows.

    ``kpis`` maps a name to ("sum" | "count", expression); counts skip NULLs. ``totals`` are further
    aggregates of the same pass.
    """
    week = F.floor(F.datediff(F.col(day), F.lit(start)) / F.lit(7)) + 1
    cells = []
    for name, (kind, value) in kpis.items():
        fold = {"sum": F.sum, "count": F.count}[kind]
        cells.append(fold(value).alias(name))
        cells += [fold(F.when(week == w, value)).alias(f"{name}_w_{w}") for w in range(1, weeks + 1)]
    return df.groupBy(*keys).agg(*cells, *totals)


def distinct_rows(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct()
