"""Equi joins. Sides are never hinted as broadcast unless their size is fixed by construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_dims(df: DataFrame, *dims: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left join dimensions on composite keys; each dimension must be unique on its keys."""
    return reduce(lambda acc, dim: acc.join(dim[0], dim[1], "left"), dims, df)


def join_all(base: DataFrame, parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Left join many tables on the same keys, which appear once in the result."""
    return reduce(lambda acc, part: acc.join(part, on, "left"), parts, base)


def inner(df: DataFrame, dim: DataFrame, keys: list[str], pred: Column | None = None) -> DataFrame:
    """Inner join against the rows of ``dim`` that satisfy ``pred``.

    A left join followed by a filter on the right side keeps the same rows; filtering first lets
    the condition reach the scan of the dimension.
    """
    return df.join(dim if pred is None else dim.where(pred), keys, "inner")


def left_filtered(df: DataFrame, right: DataFrame, keys: list[str], pred: Column) -> DataFrame:
    """Left join whose right side carries a constant condition: unmatched left rows stay."""
    return df.join(right.where(pred), keys, "left")


def left_on_expr(df: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Left join on computed keys."""
    keyed = df.withColumn("_key", left_key)
    other = right.withColumn("_key", right_key)
    return keyed.join(other, "_key", "left").drop("_key")


def spine(df: DataFrame, periods: list) -> DataFrame:
    """Every row once per period, as column ``period``: an explode, not a join."""
    labels = F.array(*[F.lit(p.label) for p in periods])
    return df.withColumn("period", F.explode(labels))


def calendar(spark, period) -> DataFrame:
    """One row per day of the period, with its ISO week, month and weekday (1 = Monday)."""
    day = F.date_add(F.lit(period.start), F.col("id").cast("int")).alias("day")
    from partner_analytics.functions import iso_week_key

    return spark.range(period.days).select(day).select(
        "day", iso_week_key(F.col("day")).alias("iso_week"),
        F.date_format("day", "yyyy-MM").alias("month"),
        (F.weekday("day") + 1).alias("weekday"),
    )


def on_day(days: DataFrame, df: DataFrame, ts: str, period) -> DataFrame:
    """Calendar left join facts: facts of the period plus one empty row per day without facts.

    Facts are filtered in place instead of being shuffled by day, which would leave only as many
    tasks as days; only the distinct days travel.
    """
    facts = df.withColumn("day", F.to_date(ts)).where(
        F.col("day").between(F.lit(period.start), F.lit(period.end)))
    idle = days.select("day").join(facts.select("day").distinct(), "day", "left_anti")
    return facts.unionByName(idle, allowMissingColumns=True)


def bucket_lookup(df: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Left join a table of time buckets on derived bucket keys.

    Several bucket rows per key multiply the facts: pass all keys the table is unique on.
    """
    return df.join(buckets, keys, "left")


def resolve(df: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Look ``columns`` up in two sources with the same keys and take the first hit."""
    a = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = df.join(a, keys, "left").join(b, keys, "left")
    for c in columns:
        both = both.withColumn(c, F.coalesce(F.col(f"_a_{c}"), F.col(f"_b_{c}")))
    return both.drop(*[f"_{s}_{c}" for s in "ab" for c in columns])


def resolve_by_priority(df: DataFrame, sources: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Look ``columns`` up in sources of one layout; for each column the first source that has a value wins.

    The sources are stacked and collapse to one row per key before the one join, which reuses their
    partitioning. So a key may repeat in a source without multiplying ``df``; of repeated rows of one
    source the least value is taken.
    """
    stacked = reduce(DataFrame.unionByName, [
        source.select(*keys, *columns, F.lit(i).alias("_rank")) for i, source in enumerate(sources)])
    first = stacked.groupBy(*keys).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct("_rank", F.col(c).alias("v"))))["v"].alias(c) for c in columns])
    return df.join(first, keys, "left")


def overridden(df: DataFrame, overrides: DataFrame, code: str, scopes: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``values`` replaced where a table of exceptions has a row that fits.

    ``overrides`` has the column ``code``, which must be equal, the ``scopes``, of which NULL fits any
    value, and a column for each of ``values``, whose expression counts where nothing fits. Of several
    rows the one with the last named scopes wins. The exceptions of a code travel as one array, so no
    row of ``df`` is multiplied.
    """
    names = list(values)
    rules = overrides.groupBy(code).agg(F.collect_list(F.struct(*scopes, *names)).alias("_rules"))

    def fits(rule: Column) -> Column:
        return reduce(lambda a, b: a & b, [rule[s].isNull() | (rule[s].eqNullSafe(F.col(s))) for s in scopes])

    def weight(rule: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(rule[s].isNotNull(), 2 ** i).otherwise(0) for i, s in enumerate(scopes)])

    best = F.array_max(F.transform(F.filter("_rules", fits), lambda r: F.struct(weight(r).alias("_w"), *[r[n].alias(n) for n in names])))
    joined = df.join(rules, code, "left").withColumn("_best", best)
    return joined.withColumns({n: F.coalesce(F.col("_best")[n], value) for n, value in values.items()}).drop("_rules", "_best")


#: bits of the reducer's bitmap, 2 MB at any size of the tables (262,144 words of 64 bits), and the bits of one of its rows while it is built
REDUCER_BITS, ROW_BITS = 2 ** 24, 32768


def reduced(large: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``large`` whose key may occur in ``small``, cut where they are scanned.

    A semi-join reducer for a join that follows: the keys of ``small`` set bits of a bitmap that has one
    fixed size, so it may be broadcast whatever the tables hold, and rows without their bit go before
    anything is shuffled. Some rows without partner stay, more of them the more keys there are; rows
    with a partner always stay, NULL keys never do.
    """
    small = small.select(*[F.col(k).cast(large.schema[k].dataType) for k in keys])  # equal values hash alike
    bit = F.pmod(F.xxhash64(*keys), F.lit(REDUCER_BITS))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    bitmap = small.where(known).select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {ROW_BITS}").alias("_part")).agg(
        F.bitmap_construct_agg(F.col("_bit") % ROW_BITS).alias("_map"))  # REDUCER_BITS / ROW_BITS rows at most
    # cut into words of 64 bits here, as taking bytes out of a long row costs more than the rest of the test
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda i: F.substring("_map", i * 8 + 1, F.lit(8))))
    words = bitmap.select("_part", each.alias("_at", "_bytes")).select(
        (F.col("_part") * (ROW_BITS // 64) + F.col("_at")).alias("_word"),
        F.conv(F.hex("_bytes"), 16, -10).cast("long").alias("_bits")).where("_bits <> 0")
    # bytes stand in order, the first as the highest of its word
    place = F.expr("(_bit & 7) + 56 - (_bit & 56)").cast("int")
    marked = large.where(known).withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    return marked.join(F.broadcast(words), "_word").where(F.getbit("_bits", place) == 1).select(*large.columns)


def in_set(df: DataFrame, members: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``members``; with ``flag``, all rows and a boolean column."""
    if flag is None:
        return df.join(members.select(*keys), keys, "left_semi")
    marked = members.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return df.join(marked, keys, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def not_in_set(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members.select(*keys), keys, "left_anti")


def cohort_repeat(orders: DataFrame, group: list[str], member: str, ts: str, period, as_of, days: int) -> DataFrame:
    """Members whose first event of the period is older than ``days``, and those who came back.

    A member returns by another event of the same group within 1..``days`` days after the first
    one. Since first and repeat belong to the same group and member, one aggregation replaces the
    self join on the member: it keeps the set of active days, at most one per calendar day of the
    horizon, and no member with many events can blow up a join.
    """
    day = F.to_date(ts)
    horizon = orders.where(day.between(F.lit(period.start), F.date_add(F.lit(period.end), days)))
    active = horizon.groupBy(*group, member).agg(F.collect_set(day).alias("_days"))
    inside = F.filter("_days", lambda d: d <= F.lit(period.end))
    first = active.withColumn("_first", F.array_min(inside)).where(F.col("_first").isNotNull())
    mature = F.datediff(F.lit(as_of), F.col("_first")) > days
    again = F.exists("_days", lambda d: (d > F.col("_first")) & (F.datediff(d, F.col("_first")) <= days))
    return first.groupBy(*group).agg(
        F.count(F.when(mature, 1)).alias("base_customers"),
        F.count(F.when(mature & again, 1)).alias("repeat_customers"),
    )
