"""Vendor KPIs of one period, one function per score card input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import (
    any_flag, count_if, count_if_nonnull, in_period, overlaps, part, ratio, round_half_away, rx, sum_if,
)
from partner_analytics.operators.joins import cohort_repeat, reduced, spine

# Order codes that needed a person to act on the order.
ACTIONABLE_CODES = [51, 52, 53, 55, 56, 57, 59, 591, 592]
# Contact reasons for missing, wrong and bad items.
COMPLAINT_REASONS = {"missing": "3B.", "wrong": "3C.", "quality": "3D."}
KEYS = ["tenant_id", "vendor_id"]


def vendor_master(t, period) -> DataFrame:
    """One row per vendor of a live country and active city with an active account.

    Vendors are unique and so are countries and cities on their keys, so no distinct is needed.
    """
    countries = t.countries().where(F.col("live") == 1).select("tenant_id", "country_name")
    cities = t.cities().where(F.col("city_active") == 1).select("tenant_id", "city_id", "city_name")
    vendors = t.vendors().where(F.col("account_status") == "Active")
    rows = vendors.join(cities, ["tenant_id", "city_id"]).join(countries, "tenant_id")
    return spine(rows.select(
        "tenant_id", "city_id", "vendor_id", "vendor_code", "vendor_name", "city_name",
        "country_name", "owner", "activation_date"), [period])


def flagged_orders(t, start=None, end=None) -> DataFrame:
    """Orders with the flags of their status."""
    return t.vendor_orders(start, end).join(t.order_status(), "status_id")


def valid_orders(t, start=None, end=None) -> DataFrame:
    status = t.order_status().where(F.col("valid_order") == 1).select("status_id")
    return t.vendor_orders(start, end).join(status, "status_id")


def order_sums(t, period, codes=ACTIONABLE_CODES, late_minutes: int = 5, reasons: dict | None = None) -> DataFrame:
    """Counts, sales, processing time and delays per vendor, in one pass over the order rows.

    The order table has one row per order and vendor, so conditional sums replace distinct counts.
    A vendor is late when it misses the limit while the courier keeps it. With ``reasons``, valid
    orders with such a complaint are counted too.
    """
    orders = flagged_orders(t, period.start, period.end)
    valid, acted = F.col("valid_order") == 1, overlaps(F.col("code_array"), codes)
    extra = []
    if reasons:
        orders = orders.join(complaint_orders(t, reasons, t.order_ids(period.start, period.end)), ["tenant_id", "order_id"], "left")
        extra = [count_if(valid & complained(reasons)).alias("complaints"), count_if(valid).alias("complaint_base")]
    return orders.groupBy("tenant_id", "city_id", "vendor_id").agg(
        count_if(valid).alias("valid_orders"),
        count_if(F.col("gross_order") == 1).alias("gross_orders"),
        count_if(F.col("failed_order_vendor") == 1).alias("failed_orders_vendor"),
        count_if(valid & (F.col("expedition_type") == "pickup")).alias("pickup_orders"),
        count_if(valid & (F.col("expedition_type") != "pickup")).alias("delivery_orders"),
        sum_if(F.col("gmv"), valid).alias("gmv"),
        sum_if(F.col("gfv"), valid).alias("gfv"),
        F.sum((F.col("confirm_minutes") * 60).cast("decimal(20,2)") / 60).cast("double").alias("processing_time"),
        F.count("confirm_minutes").alias("processing_time_count"),
        count_if(acted).alias("actionable_orders"),
        ratio(count_if(acted & valid), count_if(valid)).alias("automated_orders"),
        count_if((F.col("vendor_late_min") >= late_minutes) & (F.col("courier_late_min") < late_minutes))
        .alias("vendor_delay_sum"),
        *extra,
    )


def reported_cities(t) -> DataFrame:
    """Cities whose order figures count: real ones of live countries."""
    countries = t.countries().where(F.col("live") == 1).select("tenant_id")
    return t.cities().where(~F.col("is_test")).select("tenant_id", "city_id").join(countries, "tenant_id")


def order_kpis(t, period, codes=ACTIONABLE_CODES, late_minutes: int = 5) -> DataFrame:
    """The order figures of reported cities; dimensions join the totals, not the orders."""
    sums = order_sums(t, period, codes, late_minutes)
    return sums.join(reported_cities(t), ["tenant_id", "city_id"]).withColumn("period", F.lit(period.label))


def order_kpis_with_complaints(t, period, reasons: dict[str, str] = COMPLAINT_REASONS) -> DataFrame:
    """Order figures and complaints from one pass.

    Complaints are reported for test cities too, whose order figures stay NULL.
    """
    sums = order_sums(t, period, reasons=reasons)
    placed = sums.join(reported_cities(t).withColumn("_real", F.lit(True)), ["tenant_id", "city_id"], "left")
    keys = ["tenant_id", "city_id", "vendor_id"]
    own = [c for c in sums.columns if c not in (*keys, "complaints", "complaint_base")]
    return placed.select(
        *keys, *[F.when(F.col("_real"), F.col(c)).alias(c) for c in own],
        F.when(F.col("complaint_base") > 0, F.col("complaints")).alias("complaints"))


def conversion(t, period) -> DataFrame:
    """Check-outs per menu visit; vendors without visits are left out."""
    totals = t.funnel().where(in_period(F.col("report_date"), period)).groupBy(*KEYS).agg(
        ratio(F.sum("cr3_end"), F.sum("cr3_start")).alias("cr3"))
    return totals.where(F.col("cr3").isNotNull())


def reorder(t, period, as_of, days: int = 28) -> DataFrame:
    """Customers won in the period and those who ordered again at the same vendor."""
    from datetime import timedelta

    orders = valid_orders(t, period.start, period.end + timedelta(days=days))
    counts = cohort_repeat(orders, KEYS, "customer_id", "order_ts", period, as_of, days)
    return counts.withColumn(
        "reorder_rate", F.coalesce(ratio(F.col("repeat_customers"), F.col("base_customers")), F.lit(0.0)))


def complaint_orders(t, reasons: dict[str, str], orders: DataFrame) -> DataFrame:
    """One row per order with a 0/1 mark per reason, of ``orders`` with such a contact.

    Contacts of all time are cut to the reasons and to the orders asked about before any shuffle, and
    collapse to one row per order before they meet them.
    """
    hits = {name: rx(F.col("reason"), pattern) for name, pattern in reasons.items()}
    told = t.contacts().where(reduce(lambda a, b: a | b, hits.values()))
    return reduced(told, orders, ["order_id"]).groupBy("tenant_id", "order_id").agg(
        *[any_flag(hit).alias(name) for name, hit in hits.items()])


def complained(reasons: dict[str, str]) -> Column:
    return F.greatest(*[F.col(name) for name in reasons]) == 1


def complaints(t, period, reasons: dict[str, str] = COMPLAINT_REASONS) -> DataFrame:
    """Orders with a complaint about their items, absolute and per valid order."""
    marks = complaint_orders(t, reasons, t.order_ids(period.start, period.end))
    joined = valid_orders(t, period.start, period.end).join(marks, ["tenant_id", "order_id"], "left")
    per = joined.groupBy(*KEYS).agg(
        count_if(complained(reasons)).alias("complaints"), F.count(F.lit(1)).alias("orders"))
    return per.withColumn("complaint_rate", ratio(F.col("complaints"), F.col("orders")))


def nps(t, period, reason: str = "Packaging") -> DataFrame:
    """Mean recommendation of one reason, two decimals, for vendors of active real cities.

    The answers of the period are few: the lines of all orders are cut to theirs where they are scanned.
    """
    countries = t.countries().select("tenant_id", "country_iso")
    cities = t.cities().where((F.col("city_active") == 1) & ~F.col("is_test")).select("tenant_id", "city_id")
    answers = t.surveys().where(in_period(F.col("submitted"), period) & (F.col("reason") == reason)).select(
        F.upper(part(F.col("venture_name"), "_", 2)).alias("country_iso"),
        F.col("last_order_id").alias("order_id"), "recommendation")
    orders = t.order_vendors(answers).select("tenant_id", "order_id", "vendor_id", "city_id")
    placed = answers.join(countries, "country_iso").join(orders, ["tenant_id", "order_id"])
    score = ratio(F.sum("recommendation"), F.count("recommendation"))
    return placed.join(cities, ["tenant_id", "city_id"]).groupBy("tenant_id", "city_id", "vendor_id").agg(
        F.coalesce(round_half_away(score, 2), F.lit(0)).cast("double").alias("nps_packaging"))


def closing(t, period=None) -> DataFrame:
    """Share of closed hours in open hours, of one period or of all time."""
    rows = t.offline() if period is None else t.offline().where(in_period(F.col("report_date"), period))
    return rows.groupBy(*KEYS).agg(
        ratio(F.sum(F.coalesce("closed_hours", F.lit(0))), F.sum("open_hours")).alias("closing_hours"))


def content(t) -> DataFrame:
    """Menu size and the share of products without description, for every vendor."""
    joined = t.vendors().select("tenant_id", "vendor_id").join(t.content(), KEYS, "left")
    filled = joined.fillna(0, ["menucategories", "products", "described"])
    missing = ratio(F.col("products") - F.col("described"), F.col("products"))
    return filled.withColumn("products_without_description", F.coalesce(missing, F.lit(0.0)))


def marketing(t, patterns: dict[str, str]) -> DataFrame:
    """Contract attributes plus material found among the products sold to the vendor.

    ``patterns`` holds regular expressions for ``door_sticker``, ``voucher_cards``, ``display``,
    ``backlink`` and ``whitelabel``, and the finished ``phase`` of an implementation.
    """
    # patterns are matched once per product, not once per sale
    kind = F.col("opportunity_type")
    materials = ["door_sticker", "voucher_cards", "display"]
    catalog = t.crm_catalog().select(
        "product_id", *[rx(F.col("product_name"), patterns[m]).alias(m) for m in materials],
        rx(kind, patterns["backlink"]).alias("is_backlink"), rx(kind, patterns["whitelabel"]).alias("is_whitelabel"))
    linked = (F.col("is_backlink") & (F.col("phase") == patterns["phase"])) | F.col("is_whitelabel")
    # few products show anything; sales of the others go before the shuffle
    telling = catalog.where(reduce(lambda a, b: a | b, [F.col(c) for c in [*materials, "is_backlink", "is_whitelabel"]]))
    found = t.crm_sales(telling).join(telling, "product_id").groupBy(*KEYS).agg(
        *[any_flag(F.col(m)).alias(m) for m in materials], any_flag(linked).alias("linked"))
    terms = t.contracts().where(F.col("contract_status").isin("Activated", "Amended")).select(
        *KEYS, "commission_pct", "flat_fee", "price_mark_up", "exclusivity", "packaging_quality",
        "fb_rights", "facebook_likes", "no_fb", "website")
    joined = terms.join(found, KEYS, "left").fillna(
        0, ["door_sticker", "voucher_cards", "display", "linked"])
    backlink = F.when((F.col("linked") == 1) | F.col("website").isNull(), 1).otherwise(0)
    return joined.withColumn("backlink", backlink).drop("linked", "website")
