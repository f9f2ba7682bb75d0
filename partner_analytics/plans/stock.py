"""Stock of supplies: consumption since the last delivery, and whether to send more."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import ratio, rx
from partner_analytics.operators.joins import overridden
from partner_analytics.operators.ranking import latest
from partner_analytics.plans.kpis import valid_orders

VENDOR = ["tenant_id", "vendor_id"]
# what an exception may be limited to; the city counts for more than the tenant
PLACE = ["tenant_id", "city_name"]
SHIPPING = ["shipping_city", "shipping_phone", "shipping_street", "shipping_postcode"]
SHIPPING_TIMES = [f"times_{day}" for day in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday")]
# Bags per order by the consumption class of the contract.
CONSUMPTION = {
    "Above Average (1.5 Bags per Order)": 1.6, "Normal (1 - 1.5 per Order)": 1.1, "Average (1.1 Bags per Order)": 1.1,
}
LOW_PATTERN, LOW, USUAL = "low", 0.6, 1.1
# Days of consumption that a delivery must cover, by country.
LEAD_DAYS = {
    "Netherlands": 11, "Germany": 10, "France": 10, "Finland": 12, "Sweden": 12, "Italy": 11, "Austria": 11,
    "Norway": 9, "Hong Kong": 7, "Singapore": 7,
}


def factor(c: Column) -> Column:
    out = None
    for label, value in CONSUMPTION.items():
        out = F.when(c == label, F.lit(value)) if out is None else out.when(c == label, F.lit(value))
    return out.when(rx(c, LOW_PATTERN), F.lit(LOW)).otherwise(F.lit(USUAL))


def stock_latest(t, as_of) -> DataFrame:
    """The newest delivery per vendor with a valid contract and automatic supply, and days since, counted to yesterday."""
    valid = t.contracts().where(F.col("contract_status").isin("Activated", "Amended")).select(*VENDOR)
    terms = t.supply_terms().where(F.col("auto_supply") == 1).join(valid, VENDOR, "left_semi")
    sums = t.stock().groupBy(*VENDOR, "product_date", "consumption").agg(F.sum("quantity").alias("quantity"))
    newest = latest(sums, VENDOR, ["product_date", "consumption"], ["product_date", "consumption", "quantity"])
    yesterday = F.lit(as_of - timedelta(days=1))
    return newest.join(terms, VENDOR).select(
        *VENDOR, "product_date", "quantity", factor(F.col("consumption")).alias("bags_per_order"),
        "auto_supply", "check_stock", "check_date",
        F.datediff("product_date", yesterday).alias("days"),
        F.datediff("check_date", yesterday).alias("days_since_check"),
        F.abs(F.datediff("product_date", yesterday)).alias("days_numeric"))


def stock_use(t, as_of, weeks: int = 4, days: int = 30) -> DataFrame:
    """Orders since delivery and since check, orders per day, and the stock that should be left.

    Orders shrink to one row per vendor and day before they meet the deliveries.
    """
    daily = valid_orders(t).groupBy("tenant_id", "vendor_id", F.to_date("order_ts").alias("order_day")).agg(
        F.count(F.lit(1)).alias("orders"))
    joined = daily.join(stock_latest(t, as_of), VENDOR, "left")
    today, day = F.lit(as_of), F.col("order_day")

    def since(start: Column) -> Column:
        return F.coalesce(F.sum(F.when(day >= start, F.col("orders"))), F.lit(0))

    recent = since(F.date_sub(today, 7 * weeks))
    # a delivery dated after today counts as made the day before yesterday
    delivered = F.when(F.col("product_date") > today, F.date_sub(today, 2)).otherwise(F.col("product_date"))
    keys = ["product_date", "quantity", "bags_per_order", "auto_supply", "check_stock", "check_date", "days", "days_numeric"]
    per = joined.groupBy("tenant_id", "vendor_id", *keys).agg(
        since(F.date_add(today, F.col("days"))).alias("orders"),
        since(F.date_add(today, F.col("days_since_check"))).alias("orders_check"),
        recent.alias("orders_l4w"))
    return per.withColumns({
        "product_date": delivered,
        "order_per_day": F.col("orders_l4w") / F.lit(float(days)),
        "remaining": F.col("quantity") - F.col("orders") * F.col("bags_per_order"),
        "remaining_check": F.col("check_stock") - F.col("orders_check") * F.col("bags_per_order"),
    })


def stock_plan(use: DataFrame, vendors: DataFrame, as_of, lead_days: dict[str, int] = LEAD_DAYS,
               steps: tuple = (250, 500), bag: int = 250, fixed_tier: DataFrame | None = None) -> DataFrame:
    """Size of the next delivery by recent orders, and the need until it arrives by country.

    ``vendors`` gives country, city and activation date. ``fixed_tier`` (tenant_id, city_name, vendor_code,
    order_tier) sets the size of single vendors: codes are unique in a city only, and NULL means any.
    """
    orders = F.col("orders_l4w")
    step = F.when(orders < steps[0], 1).when(orders < steps[1], 2).otherwise(3)
    size = step * bag
    need = F.lit(None).cast("double")
    for pattern, days in reversed(lead_days.items()):
        need = F.when(rx(F.col("country_name"), pattern),
                      F.col("order_per_day") * F.col("bags_per_order") * days).otherwise(need)
    new = F.col("activation_date").between(F.date_sub(F.lit(as_of), 7), F.lit(as_of))
    placed = use.join(vendors, VENDOR)
    if fixed_tier is not None:
        placed = overridden(placed, fixed_tier, "vendor_code", PLACE, {"order_tier": size})
    else:
        placed = placed.withColumn("order_tier", size)
    return placed.withColumns({
        "tier_step": step, "estimation": need, "new_vendor": F.when(new, 1).otherwise(0)})


def stock_decision(t, plan: DataFrame, as_of, open_type: str, manual_tenants: list[int] = (),
                   always_cities: list[str] = (), billed_tenants: list[int] = (), unbilled: list[str] = (),
                   streets: DataFrame | None = None, manual_rate: float = 2) -> DataFrame:
    """Which vendors get a delivery, with fee, address and the times it can be taken.

    ``streets`` (tenant_id, city_name, vendor_code, street) names the right door of single vendors, for the
    address and the shipping street; NULL means any. An unknown shipping time shows as '-'.

    ``open_type`` is the CRM record type that marks a delivery already under way. Tenants in
    ``manual_tenants`` are served above ``manual_rate`` orders per day.
    """
    c = F.col
    under_way = t.opportunities().where((c("record_type") == open_type) & (c("stage") == "New")).select(
        *VENDOR).distinct().withColumn("under_way", F.lit(True))
    bills = t.supply_terms().select(*VENDOR, "billing_street", "billing_postcode")
    rows = plan.join(bills, VENDOR, "left").join(under_way, VENDOR, "left")
    week_ago = F.date_sub(F.lit(as_of), 7)
    checked = c("check_date") >= c("product_date")
    base = rows.withColumns({
        "remaining_used": F.when(checked & (c("product_date") < week_ago), c("remaining_check")).otherwise(c("remaining")),
        "new_stock": F.coalesce(c("check_stock").cast("double"), c("remaining")),
        "last_date": F.when(checked, c("check_date")).otherwise(c("product_date")),
        "quantity_used": F.when(checked, c("check_stock")).otherwise(c("quantity")),
        "orders_interval": F.when(c("check_date") > c("product_date"), c("orders_check")).otherwise(c("orders")),
        "regular": F.when(
            (c("order_per_day") >= 1) & ((c("product_date") < week_ago) | c("product_date").isNull())
            & ((c("check_date") < week_ago) | c("check_date").isNull()) & (c("bags_per_order") > 0.9), 1).otherwise(0),
    })
    auto, opd, free = c("auto_supply") == 1, c("order_per_day"), c("under_way").isNull()
    manual = c("tenant_id").isin(list(manual_tenants))
    empty = c("remaining_used") <= 0
    starting = ((c("new_vendor") == 1) & (opd >= 1) & (c("quantity_used") < 60) & auto
                & c("bags_per_order").isNotNull() & ~manual)
    include = (
        F.when(manual & (opd > manual_rate), "included")
        .when((c("estimation") > c("remaining_used")) | starting, "included")
        .when((opd > 1) & c("quantity_used").isNull() & auto, "included")
        .when(auto & empty & (c("orders_l4w") > 0) & free, "included")
        .when(c("city_name").isin(list(always_cities)) & auto & empty & free, "included")
        .otherwise("n.a."))
    billed = c("tenant_id").isin(list(billed_tenants)) & ~c("vendor_code").isin(list(unbilled))
    shipping = t.shipping_addresses().select("tenant_id", "vendor_code", *SHIPPING, *SHIPPING_TIMES)
    full = base.join(shipping, ["tenant_id", "vendor_code"], "left")
    if streets is not None:
        full = overridden(full, streets, "vendor_code", PLACE, {"street": F.lit(None).cast("string")})
    else:
        full = full.withColumn("street", F.lit(None).cast("string"))
    return full.select(
        "tenant_id", "vendor_id", "vendor_code", "country_name", "city_name", "product_date", "last_date",
        "remaining_used", "new_stock", "quantity", "quantity_used", "days", "orders", "orders_interval",
        "order_per_day", "orders_l4w", "order_tier", "tier_step", "estimation", "regular", "check_date", "check_stock",
        F.coalesce("street", "address_line1", "billing_street").alias("address"),
        F.coalesce("postcode", "billing_postcode").alias("postcode"),
        "shipping_city", "shipping_phone", F.coalesce("street", "shipping_street").alias("shipping_street"), "shipping_postcode",
        *[F.coalesce(day, F.lit("-")).alias(day) for day in SHIPPING_TIMES],
        include.alias("status"), F.when(billed, F.lit(0.05)).otherwise(F.lit(0.0)).alias("sales_price"),
        F.when(billed, c("order_tier")).otherwise(0).alias("billing_quantity"))


def stock_feedback(decision: DataFrame, reports: DataFrame) -> DataFrame:
    """Computed against reported stock, for vendors that reported one or not.

    Vendors report as often as they like: the newest report counts, of one day the one with the largest id.
    """
    newest = latest(reports, VENDOR, ["report_date", "report_id"], ["reported_stock", "report_date", "report_id"])
    return decision.join(newest, VENDOR, "left").select(
        *VENDOR, "remaining_used", F.col("check_stock").alias("known_stock"), "reported_stock",
        F.col("check_date").alias("known_date"), F.col("report_date").alias("reported_date"), "new_stock", "last_date", "quantity",
        "quantity_used", "orders", "order_per_day", "estimation", "status",
        (F.col("remaining_used") - F.col("reported_stock")).alias("difference"))
