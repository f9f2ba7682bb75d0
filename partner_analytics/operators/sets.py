"""Unions and unpivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brands(a: DataFrame, b: DataFrame, tenants: list[int] | None = None, names=("A", "B")) -> DataFrame:
    """Stack two equal layouts with a ``brand`` column; ``tenants`` restricts the second."""
    other = b if tenants is None else b.where(F.col("tenant_id").isin(tenants))
    return a.withColumn("brand", F.lit(names[0])).unionByName(other.withColumn("brand", F.lit(names[1])))


def union_brands(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def unpivot(df: DataFrame, keep: list, specs: list[dict[str, Column]], when: list[Column]) -> DataFrame:
    """One output row per input row and spec whose condition holds, from a single scan.

    All specs produce the same columns. A NULL condition drops the row.
    """
    rows = F.array(*[
        F.when(cond, F.struct(*[c.alias(name) for name, c in spec.items()]))
        for spec, cond in zip(specs, when)
    ])
    exploded = df.select(*keep, F.explode(rows).alias("_row")).where(F.col("_row").isNotNull())
    return exploded.select(*[c for c in exploded.columns if c != "_row"], "_row.*")
