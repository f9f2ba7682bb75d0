"""Ranking, running totals and picks per key, safe for keys that hold a large share of all rows.

A plain window sorts each key in one task. Picks (latest, first of several) are therefore
aggregations, top-n relies on the group limit that Spark applies before the shuffle, and ranks or
running totals are prefix sums over range slices. Only the narrow table of keys and order columns
is sliced and stored; its marks are joined to the lazy input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.operators.aggregates import with_group
from partner_analytics.session import reliable_checkpoint

# above this Spark does not cut groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold)
GROUP_LIMIT = 1000


@dataclass(frozen=True)
class Order:
    """A sort column by name. Descending puts NULL first, ascending puts NULL last."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def column(self) -> Column:
        first = self.descending if self.nulls_first is None else self.nulls_first
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


def asc(name: str) -> Order:
    return Order(name)


def desc(name: str) -> Order:
    return Order(name, True)


def running(df: DataFrame, keys: list[str], order: list[Order], sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``row_no`` and running sums (inclusive) per key; ``order`` must be unique per key.

    ``sums`` maps a new column to the summed one.
    """
    sums = sums or {}
    on = list(dict.fromkeys([*keys, *[o.name for o in order]]))
    narrow = df.select(*on, *[F.col(c).alias(f"_v_{name}") for name, c in sums.items()])
    marks = _sliced(narrow, keys, [o.column for o in order], {name: f"_v_{name}" for name in sums})
    return _join_marks(df, marks, on, {"row_no": F.col("row_no"), **{name: F.col(name) for name in sums}})


def _join_marks(df: DataFrame, marks: DataFrame, on: list[str], values: dict[str, Column]) -> DataFrame:
    """Joins computed columns back on keys and order columns; NULL matches NULL."""
    renamed = marks.select(*[F.col(c).alias(f"_m_{c}") for c in on], *[v.alias(name) for name, v in values.items()])
    cond = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        cond = same if cond is None else cond & same
    return df.join(renamed, cond).drop(*[f"_m_{c}" for c in on])


def _sliced(base: DataFrame, keys: list[str], sort: list[Column], sums: dict[str, str]) -> DataFrame:
    """Prefix sums in two steps: inside range slices of even size, plus the totals before a slice."""
    ranged = base.repartitionByRange(*[F.col(k) for k in keys], *sort)
    sliced = reliable_checkpoint(ranged.withColumn("_slice", F.spark_partition_id()))
    local = Window.partitionBy("_slice", *keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.select(
        "*", F.row_number().over(local).alias("_n"),
        *[F.sum(c).over(local).alias(f"_s_{name}") for name, c in sums.items()])
    totals = sliced.groupBy("_slice", *keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    # at most one row per slice and key: the number of slices bounds the window
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_slice").alias("_o_slice"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip"),
        *[F.sum(f"_t_{name}").over(before).alias(f"_p_{name}") for name in sums])
    cond = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = inside.join(offsets, cond)

    def total(name: str) -> Column:
        here, prior = F.col(f"_s_{name}"), F.col(f"_p_{name}")
        return F.when(prior.isNull(), here).when(here.isNull(), prior).otherwise(here + prior)

    return joined.select(
        *base.columns, (F.col("_n") + F.col("_skip")).cast("int").alias("row_no"),
        *[total(name).alias(name) for name in sums])


def running_peers(df: DataFrame, keys: list[str], order: list[Order], sums: dict[str, str] | None = None,
                  rank: str | None = None, count: str | None = None) -> DataFrame:
    """Running values where rows that tie in ``order`` share one value.

    ``rank`` names the rank (1 + rows strictly before), ``count`` the rows up to and including the
    ties. Ties collapse to one row before anything is sorted, so they cannot form a hot spot.
    """
    sums = sums or {}
    on = list(dict.fromkeys([*keys, *[o.name for o in order]]))
    steps = df.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_ties"), *[F.sum(c).alias(f"_v_{name}") for name, c in sums.items()])
    marks = _sliced(steps, keys, [o.column for o in order], {"_upto": "_ties", **{name: f"_v_{name}" for name in sums}})
    values = {name: F.col(name) for name in sums}
    if rank:
        values[rank] = F.col("_upto") - F.col("_ties") + 1
    if count:
        values[count] = F.col("_upto")
    return _join_marks(df, marks, on, values)


def rank_in(df: DataFrame, keys: list[str], x: str, name: str = "rank") -> DataFrame:
    """``rank()`` by ``x`` descending inside ``keys``."""
    return running_peers(df, keys, [desc(x)], rank=name)


def global_rank(df: DataFrame, x: str, name: str = "global_rank") -> DataFrame:
    """``rank()`` by ``x`` descending over all rows; its distinct values are spread over range slices."""
    return running_peers(df.withColumn("_all", F.lit(1)), ["_all"], [desc(x)], rank=name).drop("_all")


def running_count(df: DataFrame, keys: list[str], x: str, name: str = "running_count") -> DataFrame:
    """Rows of the key with a value of at least the row's own; ties share the count."""
    return running_peers(df, keys, [desc(x)], count=name)


def running_sum(df: DataFrame, keys: list[str], x: str, order: list[Order], name: str = "running_total") -> DataFrame:
    return running_peers(df, keys, order, sums={name: x})


def within_budget(df: DataFrame, keys: list[str], x: str, order: list[Order], budget: str) -> DataFrame:
    """Rows while the running total fits the key's budget; later smaller rows are not pulled in."""
    return running_sum(df, keys, x, order, "running_total").where(F.col("running_total") <= F.col(budget))


def ntile_of(row_no: Column, rows: Column, n: int) -> Column:
    """The ``ntile(n)`` of a row number: the first ``rows mod n`` tiles hold one row more."""
    size, extra = F.floor(rows / F.lit(n)), rows % n
    head = extra * (size + 1)
    return F.when(row_no <= head, F.floor((row_no - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((row_no - 1 - head) / F.nullif(size, F.lit(0))) + 1)


def in_top_ntile(df: DataFrame, keys: list[str], x: str, tie: list[str], n: int, k: int, name: str) -> DataFrame:
    """1 for rows in the first ``k`` of ``n`` tiles by ``x`` descending, else 0.

    ``tie`` makes the order unique, which ``ntile`` alone leaves open.
    """
    ranked = running(df, keys, [desc(x), *[asc(t) for t in tie]])
    sized = with_group(ranked, keys, {"_rows": F.count(F.lit(1))})
    tile = ntile_of(F.col("row_no"), F.col("_rows"), n)
    return sized.withColumn(name, F.when(tile <= k, 1).otherwise(0)).drop("row_no", "_rows")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row with the largest ``order`` tuple per key, by aggregation instead of a window."""
    rest = columns or [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def dedupe_first(df: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """One row per key, the smallest by ``tiebreak``."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*tiebreak)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def top_n(df: DataFrame, keys: list[str], x: str, tie: list[str], n: int, name: str = "rank") -> DataFrame:
    """The ``n`` largest rows per key; ``tie`` makes the order unique.

    Spark cuts each task to ``n`` rows per key before it shuffles, up to ``GROUP_LIMIT``; a larger
    ``n`` takes the prefix sums, which need no cut.
    """
    order = [desc(x), *[asc(t) for t in tie]]
    if n > GROUP_LIMIT:
        return running(df, keys, order).where(F.col("row_no") <= n).withColumnRenamed("row_no", name)
    w = Window.partitionBy(*keys).orderBy(*[o.column for o in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def share(df: DataFrame, keys: list[str], x: str, name: str = "share") -> DataFrame:
    """Percent of the key's total, cut after one decimal."""
    total = with_group(df, keys, {"_total": F.sum(x)})
    percent = F.col(x).cast("double") / F.nullif(F.col("_total").cast("double"), F.lit(0.0)) * 100
    cut = F.floor(percent.cast("decimal(28,10)") * 10) / F.lit(10.0)
    return total.withColumn(name, cut).drop("_total")


def nth_event(df: DataFrame, keys: list[str], ts: str, n: int, name: str = "nth_day") -> DataFrame:
    """The day of the n-th event per key.

    Events shrink to counts per day first, so the running count sees at most one row per day.
    """
    daily = df.groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_events"))
    w = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    reached = daily.withColumn("_upto", F.sum("_events").over(w)).where(F.col("_upto") >= n)
    return reached.groupBy(*keys).agg(F.min("_day").alias(name))
