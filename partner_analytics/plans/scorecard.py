"""Vendor score card: metrics, ladder scores, composites and money impact of one period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import BINARY, LADDERS, dish_score, facebook_score, ladder, ratio
from partner_analytics.operators.joins import join_all
from partner_analytics.operators.ranking import in_top_ntile
from partner_analytics.plans import kpis
from partner_analytics.plans.ops import OpsParams, ops_scores
from partner_analytics.plans.weights import (
    AREAS, COMMERCIAL, CONTENT, CONVERSION, KPI_IMPACT, MARKETING, OPS, OPS_FINAL,
)
from partner_analytics.session import reliable_checkpoint

VENDOR = ["tenant_id", "vendor_id"]


def metrics(t, period, as_of, reorder_period, reorder_days: int = 28, events_period=None,
            conversion: bool = True, marketing_patterns: dict | None = None, company: str = "First") -> DataFrame:
    """One wide row per vendor and period.

    The orders of the period are read once: their sums, one narrow row per vendor, are stored and feed
    the card and the ranking of vendors by sales. ``company`` names whose sales class is shown.

    ``events_period`` dates visits and surveys where they run on another clock than the orders.
    ``marketing_patterns`` derives material flags from CRM products instead of the contract row.
    """
    seen = events_period or period
    base = kpis.vendor_master(t, period)
    if marketing_patterns is None:
        terms = t.contracts().drop("contract_status", "website")
    else:
        terms = kpis.marketing(t, marketing_patterns).withColumn("photo_stage", F.lit(7))
    cr3 = kpis.conversion(t, seen) if conversion else None
    sums = reliable_checkpoint(kpis.order_kpis_with_complaints(t, period))
    classes = t.gmv_classes().where(F.col("company") == company).select("tenant_id", "vendor_code", "gmv_class")
    # the weekly card counts closed hours of all time
    parts = [
        kpis.closing(t, seen if conversion else None), terms, *([cr3] if conversion else []),
        sums.drop("city_id"),
        kpis.reorder(t, reorder_period, as_of, reorder_days).drop("reorder_rate"),
        kpis.content(t).select(*VENDOR, "menucategories", "products", "described"),
        kpis.nps(t, seen).drop("city_id"),
    ]
    wide = join_all(base, parts, VENDOR).join(classes, ["tenant_id", "vendor_code"], "left")
    if not conversion:
        wide = wide.withColumn("cr3", F.lit(None).cast("double"))

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    valid, gfv = F.col("valid_orders"), F.col("gfv").cast("double")
    gmv = F.col("gmv").cast("double")
    afv = ratio(gfv, valid)
    fee = ratio(F.coalesce(valid * F.col("flat_fee"), F.lit(0)), valid)
    out = wide.select(
        "tenant_id", "city_id", "vendor_id", "vendor_code", "vendor_name", "city_name", "country_name",
        "owner", "activation_date", "period", "valid_orders", "gross_orders", "pickup_orders",
        "delivery_orders", "failed_orders_vendor", "actionable_orders",
        gmv.alias("gmv"), gfv.alias("gfv"),
        ratio(F.col("failed_orders_vendor"), F.col("gross_orders")).alias("cancellations"),
        (F.coalesce(afv * F.col("commission_pct"), F.lit(0.0)) + fee).alias("revenue"),
        ratio(gmv, valid).alias("aov"), afv.alias("afv"),
        (1 - ratio(F.col("actionable_orders"), valid)).alias("automation_gross"),
        ratio(F.col("processing_time"), F.col("processing_time_count")).alias("processing_time"),
        ratio(F.col("vendor_delay_sum"), valid).alias("vendor_delay"),
        (1 - F.col("automated_orders")).alias("automated_orders_perc"),
        F.coalesce(ratio(F.col("repeat_customers"), F.col("base_customers")), F.lit(0.0)).alias("reorder_rate"),
        zero("base_customers").alias("base_customers"), zero("repeat_customers").alias("repeat_customers"),
        "cr3", zero("menucategories").alias("menucategories"), zero("products").alias("products"),
        zero("described").alias("described"),
        F.coalesce(ratio(F.col("products") - F.col("described"), F.col("products")), F.lit(0.0))
        .alias("products_without_description"),
        "nps_packaging", zero("packaging_quality").alias("packaging_quality"),
        F.coalesce("commission_pct", F.lit(0.0)).alias("commission_pct"),
        zero("price_mark_up").alias("price_mark_up"), zero("fb_rights").alias("fb_rights"),
        ladder(F.col("facebook_likes"), LADDERS["facebook_likes"]).alias("facebook_likes_score"),
        zero("facebook_likes").alias("facebook_likes"), "no_fb",
        zero("door_sticker").alias("door_sticker"), zero("voucher_cards").alias("voucher_cards"),
        zero("display").alias("display"), zero("backlink").alias("backlink"),
        zero("exclusivity").alias("exclusivity"),
        F.col("photo_stage").alias("stage"), "gmv_class", "complaints", "closing_hours",
    )
    return out.join(sales_tiles(base, sums), [*VENDOR, "period"])


def sales_tiles(vendors: DataFrame, sums: DataFrame) -> DataFrame:
    """Whether a vendor is in the top tiles of its city and country by sales.

    A narrow branch of the card over the stored sums: one row per vendor with its sales, stored and ranked
    twice, each time from the stored rows alone.
    """
    sales = sums.select(*VENDOR, F.col("gmv").cast("double").alias("gmv"))
    base = reliable_checkpoint(
        vendors.select(*VENDOR, "city_id", "period").join(sales, VENDOR, "left").fillna(0.0, ["gmv"]))
    city = in_top_ntile(base, ["tenant_id", "city_id", "period"], "gmv", ["vendor_id"], 100, 10, "city_top")
    country = in_top_ntile(base.drop("city_id"), ["tenant_id", "period"], "gmv", ["vendor_id"], 100, 35, "country_top")
    on = [*VENDOR, "period"]
    return city.select(*on, "city_top").join(country.select(*on, "country_top"), on)


def scored(df: DataFrame, dish: bool = True) -> DataFrame:
    """Ladder scores of the metrics; needs ``vendor_delay_score`` of the operations score."""
    rate = ratio(F.col("complaints"), F.col("valid_orders"))
    plain = {
        "commission": "commission_pct", "cr3": "cr3", "price_mark_up": "price_mark_up",
        "packaging_quality": "packaging_quality", "reorder_rate": "reorder_rate",
        "menucategories": "menucategories", "products": "products",
        "products_without_description": "products_without_description",
        "automation": "automated_orders_perc", "cancellations": "cancellations",
        "processing_time": "processing_time", "revenue": "revenue", "closing_hours": "closing_hours",
    }
    scores = {f"{name}_score": ladder(F.col(c), LADDERS[name]) for name, c in plain.items()}
    scores |= {f"{name}_score": ladder(F.col(name), BINARY)
               for name in ("door_sticker", "voucher_cards", "display", "backlink", "exclusivity")}
    scores["facebook_score"] = facebook_score(
        F.col("no_fb"), F.col("city_top"), F.col("fb_rights"), F.col("facebook_likes_score"))
    scores["complaint_rate"] = rate
    scores["customer_complaints_score"] = ladder(rate, LADDERS["customer_complaints"])
    scores["vendor_delay_score"] = F.coalesce("vendor_delay_score", F.lit(10))
    scores["dish_level_score"] = (
        dish_score(F.col("city_top"), F.col("country_top"), F.col("stage")) if dish else F.lit(10))
    return df.where(F.col("valid_orders") > 0).withColumns(scores)


def weighted(weights: dict[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * F.col(f"{name}_score")
        total = term if total is None else total + term
    return total


def areas(ops: dict[str, float]) -> Column:
    """All areas in one number, with the given weights inside operations."""
    inner = {"commercial": COMMERCIAL, "marketing": MARKETING, "conversion": CONVERSION, "content": CONTENT, "ops": ops}
    total = None
    for name, weight in AREAS.items():
        term = F.lit(weight) * weighted(inner[name])
        total = term if total is None else total + term
    return total


def composites(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "commercial": weighted(COMMERCIAL), "marketing": weighted(MARKETING),
        "conversion": weighted(CONVERSION), "content": weighted(CONTENT), "ops": weighted(OPS),
        "final_business": areas(OPS_FINAL),
    })


def impact(df: DataFrame, as_of, mature_days: int = 90) -> DataFrame:
    """Money at stake: what is missing to a full score, times the sales of the period."""
    old = F.datediff(F.lit(as_of), F.col("activation_date")) >= mature_days
    return df.withColumns({
        "impact": (F.lit(10) - areas(OPS)) * F.col("gmv"),
        "three_month_flag": F.when(old, 1).otherwise(0),
    })


def kpi_impact(df: DataFrame) -> DataFrame:
    """Money at stake per KPI: area weight x KPI weight x sales x missing score."""
    return df.withColumns({
        f"{name}_impact": F.lit(area) * F.lit(weight) * F.col("gmv") * (F.lit(10) - F.col(f"{name}_score"))
        for name, (area, weight) in KPI_IMPACT.items()
    })


def scorecard(t, grain: str, period, as_of, reorder_period, reorder_days: int = 28, events_period=None,
              events_as_of=None, ops: OpsParams = OpsParams(), marketing_patterns: dict | None = None) -> DataFrame:
    """The whole card. ``grain`` is ``month`` or ``week``: the weekly card has no conversion data
    and no photo stages, and takes material flags from CRM products."""
    weekly = grain == "week"
    wide = metrics(t, period, as_of, reorder_period, reorder_days, events_period,
                   conversion=not weekly, marketing_patterns=marketing_patterns if weekly else None)
    delay = ops_scores(t, events_as_of or as_of, ops, ranks=False).select(
        *VENDOR, "vendor_delay_score", "reliability_score", "prep_time_score", "waiting_time_score",
        "waiting_time_intercept", "prep_time_avg", "reliability_rate")
    return impact(composites(scored(wide.join(delay, VENDOR, "left"), dish=not weekly)), as_of)
