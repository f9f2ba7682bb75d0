"""Vendor ramp-up: orders in the first months, and since the vendor got going."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.plans.kpis import flagged_orders

VENDOR = ["tenant_id", "vendor_id"]
# Days after activation (both ends included), and the order that marks a start.
SPANS = {"month": 30, "3_month": 90, "6_month": 180, "year": 365}
START_ORDER, START_DAYS = 25, 180
# Fewer orders than this after that many days is a low performer.
LOW_6_MONTH, LOW_YEAR, LOW_AFTER_START = 25, 275, 250


def ramp(t, as_of, start_order: int = START_ORDER, low: tuple = (LOW_6_MONTH, LOW_YEAR, LOW_AFTER_START)) -> DataFrame:
    """Active vendors with orders per span and low-performer flags.

    Daily counts serve both the spans and the start day, which counts all orders, valid or not;
    the running count sees one row per vendor and day. Months live are days divided by twelve.
    """
    daily = flagged_orders(t).groupBy(*VENDOR, F.to_date("order_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("valid_order").alias("valid"))
    upto = F.sum("orders").over(Window.partitionBy(*VENDOR).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*VENDOR)
    started = daily.withColumn("_upto", upto).withColumn(
        "start_day", F.min(F.when(F.col("_upto") >= start_order, F.col("day"))).over(whole))
    vendors = t.vendors().where(F.col("vendor_active") == 1).join(
        t.countries().select("tenant_id", "country_name"), "tenant_id", "left").select(
        *VENDOR, "country_name", "vendor_code", "vendor_name", "activation_date")
    born = F.col("activation_date")

    def within(start, days):
        inside = F.col("day").between(start, F.date_add(start, days))
        return F.coalesce(F.sum(F.when(inside, F.col("valid"))), F.lit(0))

    counts = started.join(vendors.select(*VENDOR, "activation_date"), VENDOR).groupBy(*VENDOR).agg(
        F.max("valid").alias("_any"), *[within(born, days).alias(f"orders_first_{name}") for name, days in SPANS.items()],
        within(F.col("start_day"), START_DAYS).alias("orders_after_start"),
    ).where(F.col("_any") > 0).drop("_any")
    age = F.datediff(F.lit(as_of), born)
    return vendors.join(counts, VENDOR, "left").withColumns({
        "months_live": F.floor(age / F.lit(12)).cast("int"),
        "flag_6_month": F.when((F.col("orders_first_6_month") < low[0]) & (age > 180), 1),
        "flag_year": F.when((F.col("orders_first_year") < low[1]) & (age > 365), 1),
        "flag_after_start": F.when((F.col("orders_after_start") < low[2]) & (age > 180), 1),
    })
