"""Exceptions by tenant, city and code, shipping columns, reported stock."""

from datetime import date

from pyspark.sql import functions as F
from test_reports import Tables

from partner_analytics.operators import joins
from partner_analytics.plans import stock

NOW = date(2001, 7, 16)


def test_most_specific_exception_wins(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'Berlin', 'a', 1), (2, 'Berlin', 'a', 2), (2, 'Bonn', 'a', 3), (2, 'Bonn', 'b', 4), (3, NULL, 'a', 5)"
                     " AS t(tenant_id, city_name, code, v)")
    rules = spark.sql("SELECT * FROM VALUES (NULL, NULL, 'a', 10), (2, NULL, 'a', 20), (NULL, 'Berlin', 'a', 30), (2, 'Berlin', 'a', 40), (9, NULL, 'b', 50)"
                      " AS t(tenant_id, city_name, code, size)")
    got = joins.overridden(rows, rules, "code", ["tenant_id", "city_name"], {"size": F.col("v") * 100})
    assert sorted((r.v, r["size"]) for r in got.collect()) == [(1, 30), (2, 40), (3, 20), (4, 400), (5, 10)]


def use(spark):
    return spark.sql(
        "SELECT tenant_id, 7 AS vendor_id, date'2001-06-01' AS product_date, 100 AS quantity, 1.0D AS bags_per_order, 1 AS auto_supply,"
        " CAST(NULL AS INT) AS check_stock, CAST(NULL AS DATE) AS check_date, 10 AS days, 10 AS days_numeric, 50L AS orders, 0L AS orders_check,"
        " 60L AS orders_l4w, 2.0D AS order_per_day, 50.0D AS remaining, CAST(NULL AS DOUBLE) AS remaining_check FROM VALUES (1), (2) AS t(tenant_id)")


def tables(spark):
    """Both tenants have vendor 7 with code 'v7', in different cities; only the first has a shipping entry."""
    return Tables(
        spark,
        opportunities=spark.sql("SELECT 1 AS tenant_id, 7 AS vendor_id, 'x' AS record_type, 'Old' AS stage"),
        supply_terms=spark.sql("SELECT tenant_id, 7 AS vendor_id, 'Bill' AS billing_street, '1' AS billing_postcode FROM VALUES (1), (2) AS t(tenant_id)"),
        shipping_addresses=spark.sql(
            "SELECT 1 AS tenant_id, 'v7' AS vendor_code, 'Town' AS shipping_city, 'p' AS shipping_phone, 'Dock' AS shipping_street, '9' AS shipping_postcode,"
            " '8-17' AS times_monday, CAST(NULL AS STRING) AS times_tuesday, '8-17' AS times_wednesday, '8-17' AS times_thursday, '8-17' AS times_friday,"
            " CAST(NULL AS STRING) AS times_saturday"))


def decided(spark, t):
    vendors = spark.sql("SELECT * FROM VALUES (1, 7, 'v7', 'Berlin', 'Germany', date'2000-01-01', 'Main', '5'), (2, 7, 'v7', 'Bonn', 'France', date'2000-01-01', NULL, NULL)"
                        " AS t(tenant_id, vendor_id, vendor_code, city_name, country_name, activation_date, address_line1, postcode)")
    tiers = spark.sql("SELECT CAST(NULL AS INT) AS tenant_id, 'Berlin' AS city_name, 'v7' AS vendor_code, 999 AS order_tier")
    streets = spark.sql("SELECT 2 AS tenant_id, 'Bonn' AS city_name, 'v7' AS vendor_code, 'Gate' AS street")
    plan = stock.stock_plan(use(spark), vendors, NOW, fixed_tier=tiers)
    return stock.stock_decision(t, plan, NOW, "x", streets=streets)


def test_equal_codes_of_two_tenants_differ(spark):
    one, two = sorted(decided(spark, tables(spark)).collect(), key=lambda r: r.tenant_id)
    assert (one.order_tier, two.order_tier) == (999, 250)
    assert (one.address, one.postcode, one.shipping_street) == ("Main", "5", "Dock")
    assert (two.address, two.postcode, two.shipping_street, two.shipping_city) == ("Gate", "1", "Gate", None)
    assert [one[d] for d in stock.SHIPPING_TIMES] == ["8-17", "-", "8-17", "8-17", "8-17", "-"]
    assert {two[d] for d in stock.SHIPPING_TIMES} == {"-"}


def test_newest_report_counts(spark):
    reports = spark.sql("SELECT * FROM VALUES (1, 7, 1, date'2001-07-01', 5), (1, 7, 2, date'2001-07-02', 30), (1, 7, 3, date'2001-07-02', 20), (3, 7, 4, date'2001-07-03', 1)"
                        " AS t(tenant_id, vendor_id, report_id, report_date, reported_stock)")
    one, two = sorted(stock.stock_feedback(decided(spark, tables(spark)), reports).collect(), key=lambda r: r.tenant_id)
    assert (one.reported_stock, one.difference) == (20, 30.0)
    assert (two.reported_stock, two.difference) == (None, None) and two.remaining_used == 50.0
