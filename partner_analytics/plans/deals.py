"""Before and after: what a deal month changed for the vendors that joined it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import growth_text, in_period, nearest_int, ratio, round_half_away
from partner_analytics.operators.joins import in_set
from partner_analytics.plans.kpis import valid_orders
from partner_analytics.plans.newsletter import banner, contacts

VENDOR = ["tenant_id", "vendor_id"]


def deal_cohort(t, former, deal_type: str, vendor_ids: list[int] | None = None) -> DataFrame:
    """Active accounts that won a deal in the former month."""
    won = t.opportunities().where(
        (F.col("record_type") == deal_type) & (F.col("stage") == "Closed Won")
        & F.col("created_date").between(F.lit(former.start), F.lit(former.end)))
    vendors = t.vendors().where(F.col("account_status") == "Active")
    if vendor_ids is not None:
        vendors = vendors.where(F.col("vendor_id").isin(vendor_ids))
    return vendors.join(won.select(*VENDOR), VENDOR, "left_semi")


def deal_uplift(t, former, deal, deal_type: str, confirmed: DataFrame, vendor_ids: list[int] | None = None,
                show_from: float = 0.10) -> DataFrame:
    """Orders, customers and sales in the deal month and the month before, per vendor.

    The former month runs up to and including the first deal day, so that day counts twice.
    ``confirmed`` lists the vendors of the previous deal.
    """
    cohort = deal_cohort(t, former, deal_type, vendor_ids)
    now = in_period(F.col("order_ts"), deal)
    before = F.to_date("order_ts").between(F.lit(former.start), F.lit(deal.start))
    orders = valid_orders(t, former.start, deal.end)
    # one row per vendor and customer first: distinct customers need no expansion of the orders, and
    # the cohort meets the small table, so no vendor's orders gather in one task
    people = orders.groupBy(*VENDOR, "customer_id").agg(
        F.count(F.when(now, 1)).alias("now"), F.count(F.when(before, 1)).alias("before"),
        F.sum(F.when(now, F.col("gfv"))).alias("sales_now"), F.sum(F.when(before, F.col("gfv"))).alias("sales_before"))
    sums = people.join(cohort.select(*VENDOR), VENDOR, "left_semi").groupBy(*VENDOR).agg(
        F.sum("now").alias("orders_deal_month"), F.sum("before").alias("orders_former_month"),
        F.sum("sales_now").alias("sales_now"), F.sum("sales_before").alias("sales_before"),
        F.count(F.when(F.col("now") > 0, 1)).alias("customers_deal_month"),
        F.count(F.when(F.col("before") > 0, 1)).alias("customers_former_month"))
    growth = ratio(F.col("orders_deal_month"), F.col("orders_former_month")) - 1
    rows = (
        in_set(cohort, confirmed, VENDOR, flag="_confirmed")
        .join(sums, VENDOR, "left").join(banner(t), VENDOR, "left").join(contacts(t), "vendor_code", "left")
        .join(t.countries().select("tenant_id", "country_name"), "tenant_id", "left")
        .join(t.cities().select("tenant_id", "city_id", "city_name"), ["tenant_id", "city_id"], "left")
    )
    return rows.select(
        *VENDOR, "vendor_code", "vendor_name", "country_name", "city_name", "email",
        F.lit(deal.label).alias("deals_month"), F.when(F.col("_confirmed"), "True").otherwise("False").alias("deal_former_month"),
        "activation_date", "orders_deal_month", "orders_former_month",
        round_half_away(F.col("sales_now"), 0).cast("double").alias("sales_deal_month"),
        round_half_away(F.col("sales_before"), 0).cast("double").alias("sales_former_month"),
        "customers_deal_month", "customers_former_month", growth.alias("growth"),
        nearest_int(ratio(F.col("sales_now"), F.col("orders_deal_month"))).alias("afv_deal_month"), "banner",
        growth_text(growth).alias("growth_orders"), F.when(growth >= show_from, "True").otherwise("False").alias("display_growth"))
