"""Configuration audit: fourteen flags per active vendor."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import bad_phone, close_second, not_enabled, rx
from partner_analytics.operators.aggregates import having
from partner_analytics.operators.joins import inner, join_all
from partner_analytics.plans.kpis import valid_orders

VENDOR = ["tenant_id", "vendor_id"]
FLAGS = [
    "weird_opening_hours", "false_testing", "testing_not_flagged", "autocall_not_enabled", "no_delivery",
    "vat_issue", "no_discount", "no_voucher", "calls_delay_error", "improper_phone", "no_active_menu",
    "no_online_payment", "inactive_city", "crm_inactive",
]


def mark(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def short_days(t, hours: int = 3) -> DataFrame:
    """1 for vendors with a weekday that is open for less than ``hours``."""
    per_day = t.schedules().groupBy(*VENDOR, "weekday").agg(
        F.sum(close_second(F.col("stop_s")) - F.col("start_s")).alias("open_s"))
    return per_day.groupBy(*VENDOR).agg(F.max(mark(F.col("open_s") < hours * 3600)).alias("short_day"))


def inactive_city(t) -> DataFrame:
    """Vendors of managed countries; 1 for live vendors in an inactive or unknown city."""
    managed = inner(t.vendors(), t.countries().select("tenant_id", "managed"), ["tenant_id"], F.col("managed"))
    placed = managed.join(t.cities().select("tenant_id", "city_id", "city_name", "city_active"), ["tenant_id", "city_id"], "left")
    off = (F.col("city_active") == 0) | F.col("city_active").isNull()
    live = (F.col("vendor_deleted") == 0) & (F.col("vendor_active") == 1) & (F.col("vendor_testing") == 0)
    return placed.select(*VENDOR, "city_name", mark(off & live).alias("inactive_city"))


def false_testing(t, as_of, days: int = 30, minimum: int = 0) -> DataFrame:
    """Vendors marked as test that still got valid orders lately; orders are counted before the join."""
    testing = t.vendors().where(F.col("vendor_testing") == 1).select(*VENDOR)
    counts = having(valid_orders(t, as_of - timedelta(days=days)), VENDOR, F.count("order_id"), "valid_orders", minimum)
    return counts.join(testing, VENDOR, "left_semi")


def vat_flag(vat: Column, deleted: Column, tenant: Column, brand: Column, reversed_tenants: list[int]) -> Column:
    """VAT must be included, except for ``reversed_tenants`` of the first brand, where it must not.

    In the second brand a missing setting counts even for deleted vendors.
    """
    kept, reverse = deleted == 0, tenant.isin(reversed_tenants)
    first = F.when(reverse, mark((vat == 1) & kept)).otherwise(mark(not_enabled(vat) & kept))
    second = mark(vat.isNull() | ((vat != 1) & kept))
    return F.when(brand == "A", first).otherwise(second)


def backend_audit(t, as_of, reversed_tenants: list[int], test_pattern: str = "Test") -> DataFrame:
    """Active vendors with at least one flag, both brands in one pass.

    A NULL flag makes the sum NULL and hides the vendor: no schedule, or no managed country.
    """
    c = F.col
    wide = join_all(
        t.vendors().where(c("vendor_active") == 1),
        [false_testing(t, as_of).select(*VENDOR, c("valid_orders").alias("test_orders")), inactive_city(t)], VENDOR,
    ).join(short_days(t), VENDOR, "left").join(
        t.countries().select("tenant_id", "country_name"), "tenant_id", "left")
    kept = c("vendor_deleted") == 0
    flags = {
        "weird_opening_hours": F.when((c("vendor_active") == 1) & kept, c("short_day")).otherwise(0),
        "false_testing": mark((c("test_orders") > 0) & kept),
        "testing_not_flagged": mark(rx(c("vendor_name"), test_pattern) & (c("vendor_testing") != 1) & kept),
        "autocall_not_enabled": mark(not_enabled(c("automatic_calls_enabled")) & kept),
        "no_delivery": mark(not_enabled(c("accept_delivery")) & kept),
        "vat_issue": vat_flag(c("vat_included"), c("vendor_deleted"), c("tenant_id"), c("brand"), reversed_tenants),
        "no_discount": mark(not_enabled(c("accept_discount")) & kept),
        "no_voucher": mark(not_enabled(c("accept_voucher")) & kept),
        "calls_delay_error": mark((c("automatic_calls_delay").isNull() | ~c("automatic_calls_delay").isin(1, 2)) & kept),
        "improper_phone": mark(bad_phone(c("phone"), 8) & kept),
        "no_active_menu": mark((c("active_menus") < 1) & kept),
        "no_online_payment": mark(not_enabled(c("online_payment")) & kept),
        "inactive_city": c("inactive_city"),
        "crm_inactive": mark(~c("account_status").isin("Active", "Qualified") & kept),
    }
    out = wide.select("brand", "tenant_id", "country_name", "city_name", "vendor_id", "vendor_code", "vendor_name",
                      *[flag.alias(name) for name, flag in flags.items()])
    return out.where(sum((c(f) for f in FLAGS[1:]), c(FLAGS[0])) > 0)
