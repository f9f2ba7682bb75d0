"""Order-level delay attribution between courier and vendor."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import clamp0, half_hour, iso_week_key, minutes_between, round_half_away, shift_zone
from partner_analytics.operators.joins import bucket_lookup, calendar, resolve_by_priority


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def delay_attribution(t, period, as_of, company_weeks: dict[str, int], weeks: int = 8, platforms: list[str] = ("ours",),
                      zones: list[tuple[int, int, str, str]] = (), minutes: int = 5, rate: float = 1.0, lead_days: int = 31) -> DataFrame:
    """One row per completed order of the period (and one per day without any), with who was late.

    Orders and vendors are looked up in both brands by tenant and local id, and the first brand that
    knows a value wins. A country's ``company`` decides how many weeks back its orders are reported;
    other companies, unknown ones and empty days take ``weeks``. Platforms are compared without case.
    ``zones`` lists (tenant, city, clock zone, zone meant) of couriers whose devices run in the wrong
    zone. ``rate`` converts order values of the second brand. An order is placed ``lead_days`` before
    its delivery at most, which bounds the orders that are read.
    """
    day = F.to_date("delivered_ts")
    done = t.dispatch_orders().where(
        day.between(F.lit(period.start), F.lit(period.end)) & (F.col("dispatch_status") == "completed")
        & F.lower("platform").isin([p.lower() for p in platforms])).select(
            "tenant_id", "order_id", "delivered_ts", "picked_ts", "courier_late_min", "vendor_late_min", "prep_min", "prep_buffer")
    placed = t.placed_orders().where(F.to_date("order_ts").between(
        F.date_sub(F.lit(period.start), lead_days), F.lit(period.end)))
    found = ["gfv", "vendor_id", "city_id", "preorder", "confirm_ts"]
    price = F.col("gfv").cast("double")
    brands = [placed.where(F.col("brand") == b).withColumn("gfv", price * F.lit(float(r))) for b, r in (("A", 1.0), ("B", rate))]
    ordered = resolve_by_priority(done, brands, ["tenant_id", "order_id"], found)
    shops = [t.vendors().where(F.col("brand") == b) for b in "BA"]
    resolved = resolve_by_priority(ordered, shops, ["tenant_id", "vendor_id"], ["vendor_name", "vendor_code"])
    picked: Column = F.col("picked_ts")
    for tenant, city, clock, meant in zones:
        here = (F.col("tenant_id") == tenant) & (F.col("city_id") == city)
        picked = F.when(here, shift_zone(F.col("picked_ts"), clock, meant)).otherwise(picked)
    cooking = F.when(
        (F.col("courier_late_min") > 10) | (F.col("preorder") == 1), F.col("prep_min").cast("double"),
    ).otherwise(round_half_away(minutes_between(picked, F.col("confirm_ts")), 2).cast("double"))
    timed = resolved.withColumns({"half_hour": half_hour(F.col("delivered_ts")), "cooking_time": cooking, "day": day})
    # the days that have orders come from the filtered dispatch orders, not from what was looked up for them
    idle = calendar(t.spark, period).select("day").join(done.select(day.alias("day")).distinct(), "day", "left_anti")
    spread = timed.unionByName(idle, allowMissingColumns=True).withColumn("weekday", F.weekday("day") + 1)
    named = (
        bucket_lookup(spread, t.prep_buckets(), ["tenant_id", "weekday", "half_hour"])
        .join(t.countries().select("tenant_id", "country_name", "company"), "tenant_id", "left")
        .join(t.cities().select("tenant_id", "city_id", "city_name"), ["tenant_id", "city_id"], "left")
    )
    rider, vendor = F.col("courier_late_min") >= minutes, F.col("vendor_late_min") >= minutes
    rider, vendor = F.coalesce(rider, F.lit(False)), F.coalesce(vendor, F.lit(False))

    def mark(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    def weeks_back(n: int) -> Column:
        return F.lit(monday(as_of) - timedelta(weeks=n))

    since = weeks_back(weeks)
    for company, own in company_weeks.items():
        since = F.when(F.col("company") == company, weeks_back(own)).otherwise(since)
    return named.where(F.col("day") >= since).select(  # both sides of the bound are Mondays
        "day", iso_week_key(F.col("day")).alias("week"), "weekday", "tenant_id", "country_name", "city_name",
        "vendor_name", "vendor_code", F.col("bucket").alias("hour_bucket"), F.floor("half_hour").alias("order_hour"),
        "order_id", "gfv", clamp0(F.col("courier_late_min")).alias("net_rider_delay"),
        clamp0(F.col("vendor_late_min")).alias("net_vendor_delay"),
        mark(vendor & rider).alias("delay_mix"), mark(~vendor & rider).alias("delay_rider"),
        mark(vendor & ~rider).alias("delay_vendor"), F.col("prep_min").alias("prep_time"), "prep_buffer",
        "cooking_time", F.lit(1).alias("valid_orders"), mark(F.col("vendor_late_min") > 0).alias("delay_flag"))
