"""Sources, sinks, joins, aggregations, windows and set operations."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from partner_analytics import functions as X
from partner_analytics import periods
from partner_analytics.catalog.core import (
    MONTH, REPEAT_DAYS, REPEAT_YEAR, WEEK, between, day, numbers,
)
from partner_analytics.catalog.oracle import R, define, sql
from partner_analytics.catalog.registry import query
from partner_analytics.operators import aggregates, filters, joins, ranking, sets, sinks
from partner_analytics.operators.ranking import asc, desc
from partner_analytics.session import shared_folder
from partner_analytics.sources.crm import crm
from partner_analytics.sources.lookups import OPPORTUNITY_COLUMNS, OPPORTUNITY_ROWS, opportunity_params
from partner_analytics.sources.tables import AS_OF

C = F.col
LAST_DAYS = periods.fixed(date(2001, 7, 20), date(2001, 8, 10))
QUARTER = periods.fixed(date(2001, 4, 1), date(2001, 6, 30))

define("opportunity_params", f"""
SELECT opportunity, CAST(opportunity_points AS DECIMAL(6,2)) AS opportunity_points, lifespan_days, opportunity_area,
  low_limit_absolute, low_limit_scoring, record_type_id
FROM (VALUES {OPPORTUNITY_ROWS.strip()}) AS t({OPPORTUNITY_COLUMNS})""")


# -- sources ----------------------------------------------------------------------------------

@query("src_fact_scan", sql(f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_day, o_orderstatus AS status_id
FROM orders WHERE {between('CAST(o_orderdate AS DATE)', QUARTER)}"""))
def src_fact_scan(t):
    return t.orders_raw(QUARTER.start, QUARTER.end).select(
        C("o_orderkey").alias("order_id"), C("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_day"), C("o_orderstatus").alias("status_id"))


@query("src_dim_scan", sql(f"""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%G-%V') AS iso_week,
  strftime(o_orderdate, '%Y-%m') AS month, isodow(o_orderdate) AS weekday, o_orderstatus AS status_id
FROM orders WHERE {between('CAST(o_orderdate AS DATE)', QUARTER)}"""))
def src_dim_scan(t):
    days = joins.calendar(t.spark, QUARTER)
    seen = aggregates.distinct_rows(
        t.orders_raw(QUARTER.start, QUARTER.end), F.to_date("o_orderdate").alias("day"), C("o_orderstatus").alias("status_id"))
    return seen.join(days, "day").select("day", "iso_week", "month", C("weekday").cast("bigint").alias("weekday"), "status_id")


@query("src_crm_scan", sql("""
SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS record_type FROM customer"""))
def src_crm_scan(t):
    extract = t.raw("customer").select(
        C("c_custkey").alias("18 Char Account ID"), C("c_name").alias("Account Name"),
        C("c_mktsegment").alias("Account Record Type"), C("c_acctbal").alias("Open Balance"))
    return crm(extract, {
        "18 Char Account ID": "account_id", "Account Name": "account_name", "Account Record Type": "record_type"})


@query("src_brand_union", sql("""
SELECT brand, tenant_id, vendor_id, vendor_name FROM vendors WHERE brand = 'A' OR tenant_id = 3"""))
def src_brand_union(t):
    rows = t.vendors().select("brand", "tenant_id", "vendor_id", "vendor_name")
    first, second = rows.where(C("brand") == "A").drop("brand"), rows.where(C("brand") == "B").drop("brand")
    return sets.brands(first, second, tenants=[3])


@query("src_period_params", sql(f"""
SELECT p AS period, COUNT(*) AS orders, MIN(CAST(o_orderdate AS DATE)) AS first_day, MAX(CAST(o_orderdate AS DATE)) AS last_day
FROM orders JOIN (VALUES ('month', DATE '2001-06-01', DATE '2001-06-30'), ('week', DATE '2001-07-09', DATE '2001-07-15'),
  ('weeks', DATE '2001-05-21', DATE '2001-07-15'), ('fixed', DATE '2001-04-01', DATE '2001-06-30')) AS t(p, a, b)
ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY 1"""))
def src_period_params(t):
    named = {"month": periods.period(AS_OF, "month"), "week": periods.period(AS_OF, "week"),
             "weeks": periods.period(AS_OF, "weeks", 8), "fixed": QUARTER}
    d = F.to_date("o_orderdate")
    marks = F.array(*[F.when(X.in_period(d, p), F.lit(name)) for name, p in named.items()])
    rows = t.orders_raw(min(p.start for p in named.values()), max(p.end for p in named.values()))
    return rows.select(d.alias("day"), F.explode(F.array_compact(marks)).alias("period")).groupBy("period").agg(
        F.count(F.lit(1)).alias("orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("src_lookup_inline", sql("""
SELECT record_type, opportunity_area, lifespan_days, record_type_id, COUNT(*) AS n,
  CAST(SUM(opportunity_points) AS DOUBLE) AS points
FROM opportunities JOIN opportunity_params ON record_type = opportunity GROUP BY 1, 2, 3, 4"""))
def src_lookup_inline(t):
    counts = t.opportunities().groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
    params = opportunity_params(t.spark)
    return counts.join(params, C("record_type") == C("opportunity")).select(
        "record_type", "opportunity_area", "lifespan_days", "record_type_id", "n",
        (C("opportunity_points") * C("n")).cast("double").alias("points"))


# -- sinks ------------------------------------------------------------------------------------

def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid4().hex[:8]}"


@query("snk_stage", sql("""
SELECT tenant_id, COUNT(*) AS vendors, COUNT(DISTINCT owner) AS owners FROM vendors GROUP BY 1"""))
def snk_stage(t):
    sinks.stage(t.vendors(), "stage_vendors")
    return t.spark.sql(
        "SELECT tenant_id, count(*) AS vendors, count(DISTINCT owner) AS owners FROM stage_vendors GROUP BY tenant_id")


@query("snk_table_replace", sql("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"))
def snk_table_replace(t):
    path = scratch(t, "replace")
    sinks.write_replace(t.raw("nation"), path)
    sinks.write_replace(t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return sinks.read_back(t.spark, path)


@query("snk_truncate_insert", sql("""
SELECT o_orderkey, o_totalprice * 2 AS price, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'"""))
def snk_truncate_insert(t):
    path = scratch(t, "insert")
    rows = t.raw("orders").select("o_orderkey", C("o_totalprice").alias("price"), "o_orderstatus")
    sinks.write_replace(rows, path, ["o_orderstatus"])
    changed = rows.where(C("o_orderstatus") != "O").withColumn("price", C("price") * 2)
    sinks.truncate_insert(changed, path, ["o_orderstatus"])
    return sinks.read_back(t.spark, path)


@query("snk_csv_export", sql("""
SELECT CAST(vendor_id AS VARCHAR) AS vendor_id, vendor_name, COALESCE(CAST(chain_id AS VARCHAR), ' ') AS chain_id,
  CAST(activation_date AS VARCHAR) AS activation_date FROM vendors"""))
def snk_csv_export(t):
    path = scratch(t, "csv")
    sinks.write_csv(t.vendors().select("vendor_id", "vendor_name", "chain_id", "activation_date"), path)
    return t.spark.read.option("header", True).csv(path)


# -- joins ------------------------------------------------------------------------------------

@query("join_left_composite", sql("""
SELECT o.order_id, o.vendor_id, v.vendor_name, c.city_name, s.valid_order
FROM vendor_orders o LEFT JOIN vendors v ON o.tenant_id = v.tenant_id AND o.vendor_id = v.vendor_id
LEFT JOIN cities c ON o.tenant_id = c.tenant_id AND o.city_id = c.city_id
LEFT JOIN order_status s ON o.status_id = s.status_id"""))
def join_left_composite(t):
    return joins.with_dims(
        t.vendor_orders(),
        (t.vendors().select("tenant_id", "vendor_id", "vendor_name"), ["tenant_id", "vendor_id"]),
        (t.cities().select("tenant_id", "city_id", "city_name"), ["tenant_id", "city_id"]),
        (t.order_status().select("status_id", "valid_order"), ["status_id"]),
    ).select("order_id", "vendor_id", "vendor_name", "city_name", "valid_order")


@query("join_left_using", sql("""
SELECT vendor_id, vendor_code, commission_pct, products, closed FROM vendors LEFT JOIN contracts USING (vendor_id)
LEFT JOIN content USING (vendor_id)
LEFT JOIN (SELECT vendor_id, CAST(SUM(closed_hours) AS BIGINT) AS closed FROM offline GROUP BY 1) h USING (vendor_id)"""))
def join_left_using(t):
    closed = t.offline().groupBy("vendor_id").agg(F.sum("closed_hours").alias("closed"))
    parts = [t.contracts().select("vendor_id", "commission_pct"), t.content().select("vendor_id", "products"), closed]
    return joins.join_all(t.vendors().select("vendor_id", "vendor_code"), parts, ["vendor_id"])


@query("join_inner", sql("""
SELECT vendor_id, country_name, country_iso FROM vendors v JOIN countries c ON v.tenant_id = c.tenant_id WHERE managed"""))
def join_inner(t):
    return joins.inner(t.vendors(), t.countries(), ["tenant_id"], C("managed")).select(
        "vendor_id", "country_name", "country_iso")


@query("join_left_as_inner", sql("""
SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"""))
def join_left_as_inner(t):
    buyers = t.raw("customer").select(C("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return joins.inner(t.raw("orders"), buyers, ["o_custkey"], C("c_acctbal") > 5000).select("o_orderkey", "c_name")


WEEKS = [periods.Period(periods.week_start(AS_OF, n), periods.week_start(AS_OF, n), periods.iso_week(periods.week_start(AS_OF, n)))
         for n in range(1, 5)]


@query("join_cross_spine", sql(f"""
SELECT vendor_id, vendor_code, week AS period FROM vendors CROSS JOIN
  (SELECT DISTINCT strftime(d, '%G-%V') AS week FROM (SELECT unnest(range(DATE '2001-06-18', DATE '2001-07-16', INTERVAL 1 DAY)) AS d))"""))
def join_cross_spine(t):
    return joins.spine(t.vendors().select("vendor_id", "vendor_code"), WEEKS)


@query("join_date_spine", sql(f"""
SELECT CAST(d AS DATE) AS day, o_orderkey, o_custkey
FROM (SELECT unnest(range({day(LAST_DAYS.start)}, DATE '2001-08-11', INTERVAL 1 DAY)) AS d) c
LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE)"""))
def join_date_spine(t):
    orders = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.on_day(joins.calendar(t.spark, LAST_DAYS), orders, "o_orderdate", LAST_DAYS).select(
        "day", "o_orderkey", "o_custkey")


@query("join_on_constant", sql("""
SELECT v.vendor_id, c.commission_pct FROM vendors v
LEFT JOIN contracts c ON v.vendor_id = c.vendor_id AND c.contract_status = 'Activated' AND c.exclusivity = 1"""))
def join_on_constant(t):
    pred = (C("contract_status") == "Activated") & (C("exclusivity") == 1)
    return joins.left_filtered(t.vendors().select("vendor_id"), t.contracts(), ["vendor_id"], pred).select(
        "vendor_id", "commission_pct")


@query("join_expr_key", sql("""
SELECT last_order_id, venture_name, country_name FROM surveys
LEFT JOIN countries ON upper(split_part(venture_name, '_', 2)) = country_iso"""))
def join_expr_key(t):
    key = F.upper(X.part(C("venture_name"), "_", 2))
    return joins.left_on_expr(t.surveys(), t.countries(), key, C("country_iso")).select(
        "last_order_id", "venture_name", "country_name")


@query("join_half_hour_bucket", sql("""
SELECT delivery_id, bucket FROM (SELECT delivery_id, vendor_id, isodow(ts) AS weekday,
    hour(ts) + CASE WHEN minute(ts) <= 15 THEN 0 WHEN minute(ts) < 45 THEN 0.5 ELSE 1 END::DOUBLE AS half_hour FROM deliveries) d
LEFT JOIN home h ON h.vendor_id = d.vendor_id
LEFT JOIN prep_buckets b ON b.tenant_id = h.tenant_id AND b.weekday = d.weekday AND b.half_hour = d.half_hour"""))
def join_half_hour_bucket(t):
    timed = t.deliveries().withColumns({"weekday": F.weekday("ts") + 1, "half_hour": X.half_hour(C("ts"))})
    return joins.bucket_lookup(timed, t.prep_buckets(), ["tenant_id", "weekday", "half_hour"]).select("delivery_id", "bucket")


@query("join_two_source_resolve", sql("""
SELECT delivery_id, d.vendor_id, COALESCE(a.vendor_name, b.vendor_name) AS vendor_name, COALESCE(a.city_id, b.city_id) AS city_id
FROM deliveries d LEFT JOIN (SELECT * FROM vendors WHERE brand = 'A') a ON d.vendor_id = a.vendor_id
LEFT JOIN (SELECT * FROM vendors WHERE brand = 'B') b ON d.vendor_id = b.vendor_id"""))
def join_two_source_resolve(t):
    first, second = (t.vendors().where(C("brand") == b) for b in "AB")
    found = joins.resolve(
        t.deliveries().select("delivery_id", "vendor_id"), first, second, ["vendor_id"], ["vendor_name", "city_id"])
    return found.select("delivery_id", "vendor_id", "vendor_name", "city_id")


@query("join_semi_in", sql("""
SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""))
def join_semi_in(t):
    people = t.raw("customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    solvent = joins.in_set(t.raw("orders"), people.where(C("c_acctbal") > 0), ["o_custkey"])
    return joins.in_set(solvent, people.where(C("c_mktsegment") == "MACHINERY"), ["o_custkey"], flag="machinery").select(
        "o_orderkey", "machinery")


@query("join_anti_isnull", sql(f"""
SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE
  {between('CAST(o_orderdate AS DATE)', MONTH)}) o ON o_custkey = c_custkey WHERE o_custkey IS NULL"""))
def join_anti_isnull(t):
    active = t.orders_raw(MONTH.start, MONTH.end).select(C("o_custkey").alias("c_custkey"))
    return joins.not_in_set(t.raw("customer"), active, ["c_custkey"]).select("c_custkey", "c_name")


@query("join_cohort_events", sql(f"""
SELECT c_nationkey, COUNT(DISTINCT CASE WHEN {day(AS_OF)} - first_day > {REPEAT_DAYS} THEN f.o_custkey END) AS base_customers,
  COUNT(DISTINCT CASE WHEN {day(AS_OF)} - first_day > {REPEAT_DAYS} AND CAST(o.o_orderdate AS DATE) - first_day BETWEEN 1 AND {REPEAT_DAYS}
    THEN f.o_custkey END) AS repeat_customers
FROM (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders
      WHERE {between('CAST(o_orderdate AS DATE)', REPEAT_YEAR)} GROUP BY 1) f
JOIN customer ON f.o_custkey = c_custkey LEFT JOIN orders o ON o.o_custkey = f.o_custkey GROUP BY 1"""))
def join_cohort_events(t):
    home = t.raw("customer").select(C("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = t.raw("orders").select("o_custkey", "o_orderdate").join(home, "o_custkey")
    return joins.cohort_repeat(orders, ["c_nationkey"], "o_custkey", "o_orderdate", REPEAT_YEAR, AS_OF, REPEAT_DAYS)


# -- aggregations -----------------------------------------------------------------------------

@query("agg_group_basic", sql(f"""
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, {R("CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE)", 2)} AS total,
  {R("CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*)", 4)} AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high
FROM orders GROUP BY 1, 2"""))
def agg_group_basic(t):
    price = C("o_totalprice").cast("decimal(12,2)")
    return aggregates.aggregate(t.raw("orders"), ["o_orderstatus", "o_orderpriority"], {
        "n": F.count(F.lit(1)), "total": X.measure(F.sum(price), 2),
        "mean": X.measure(X.ratio(F.sum(price), F.count(F.lit(1))), 4),
        "low": F.min("o_totalprice"), "high": F.max("o_totalprice")})


@query("agg_count_distinct_filter", sql("""
SELECT l_suppkey, COUNT(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'A') AS orders_a,
  COUNT(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS orders_r,
  COUNT(DISTINCT l_orderkey) FILTER (WHERE l_quantity > 40) AS orders_big FROM lineitem GROUP BY 1"""))
def agg_count_distinct_filter(t):
    return aggregates.distinct_counts(t.raw("lineitem"), ["l_suppkey"], "l_orderkey", {
        "orders_a": C("l_returnflag") == "A", "orders_r": C("l_returnflag") == "R", "orders_big": C("l_quantity") > 40})


@query("agg_sum_filter", sql(f"""
SELECT vendor_id, {R("CAST(SUM(gmv) FILTER (WHERE valid_order = 1) AS DOUBLE)", 2)} AS gmv_valid,
  {R("CAST(SUM(gfv) FILTER (WHERE failed_order_vendor = 1) AS DOUBLE)", 2)} AS gfv_lost,
  {R("AVG(confirm_minutes) FILTER (WHERE expedition_type = 'pickup')", 4)} AS pickup_confirm FROM flagged_orders GROUP BY 1"""))
def agg_sum_filter(t):
    orders = t.vendor_orders().join(t.order_status(), "status_id")
    return orders.groupBy("vendor_id").agg(
        X.measure(X.sum_if(C("gmv"), C("valid_order") == 1), 2).alias("gmv_valid"),
        X.measure(X.sum_if(C("gfv"), C("failed_order_vendor") == 1), 2).alias("gfv_lost"),
        X.measure(F.avg(F.when(C("expedition_type") == "pickup", C("confirm_minutes"))), 4).alias("pickup_confirm"))


@query("agg_count_filter_nonnull", sql("""
SELECT owner, COUNT(chain_id) FILTER (WHERE vendor_active = 1) AS chained, COUNT(phone) FILTER (WHERE vendor_deleted = 0) AS phones,
  COUNT(vendor_id) FILTER (WHERE accept_voucher = 1) AS vouchers FROM vendors GROUP BY 1"""))
def agg_count_filter_nonnull(t):
    return t.vendors().groupBy("owner").agg(
        X.count_if_nonnull(C("chain_id"), C("vendor_active") == 1).alias("chained"),
        X.count_if_nonnull(C("phone"), C("vendor_deleted") == 0).alias("phones"),
        X.count_if_nonnull(C("vendor_id"), C("accept_voucher") == 1).alias("vouchers"))


@query("agg_count_distinct_case", sql("""
SELECT user_id, COUNT(DISTINCT CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS view_days,
  COUNT(DISTINCT CASE WHEN value > 50 THEN CAST(ts AS DATE) END) AS rich_days FROM events GROUP BY 1"""))
def agg_count_distinct_case(t):
    return aggregates.distinct_counts(t.raw("events"), ["user_id"], F.to_date("ts"), {
        "view_days": C("event_type") == "view", "rich_days": C("value") > 50})


@query("agg_max_flag", sql("""
SELECT l_suppkey, COALESCE(MAX(1) FILTER (WHERE regexp_matches(p_name, 'red ring', 'i') AND l_quantity = 50), 0) AS ring,
  COALESCE(MAX(1) FILTER (WHERE regexp_matches(p_type, 'promo', 'i') AND l_linestatus = 'F' AND l_discount = 0), 0) AS promo
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""))
def agg_max_flag(t):
    parts = t.raw("part").select(C("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return t.raw("lineitem").join(parts, "l_partkey").groupBy("l_suppkey").agg(
        X.any_flag(X.rx(C("p_name"), "red ring") & (C("l_quantity") == 50)).alias("ring"),
        X.any_flag(X.rx(C("p_type"), "promo") & (C("l_linestatus") == "F") & (C("l_discount") == 0)).alias("promo"))


@query("agg_threshold_flag", sql("""
SELECT account_id, CASE WHEN COUNT(account_id) FILTER (WHERE record_type = 'Partner - OM Backlink') >= 1 THEN 1 ELSE 0 END AS backlink,
  CASE WHEN COUNT(account_id) FILTER (WHERE stage = 'New') >= 3 THEN 1 ELSE 0 END AS busy FROM opportunities GROUP BY 1"""))
def agg_threshold_flag(t):
    return t.opportunities().groupBy("account_id").agg(
        X.at_least(C("record_type") == "Partner - OM Backlink", 1).alias("backlink"),
        X.at_least(C("stage") == "New", 3).alias("busy"))


@query("agg_having", sql("""
SELECT o_custkey, COUNT(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS valid_orders FROM orders GROUP BY 1
HAVING COUNT(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'P') > 7"""))
def agg_having(t):
    valid = X.distinct_if(C("o_orderkey"), C("o_orderstatus") != "P")
    return aggregates.having(t.raw("orders"), ["o_custkey"], valid, "valid_orders", 7)


@query("agg_interval_sum", sql("""
SELECT vendor_id, weekday, CAST(SUM(CASE WHEN stop_s = 0 THEN 86340 ELSE stop_s END - start_s) AS BIGINT) AS open_s,
  CASE WHEN SUM(CASE WHEN stop_s = 0 THEN 86340 ELSE stop_s END - start_s) < 3 * 3600 THEN 1 ELSE 0 END AS short_day
FROM schedules GROUP BY 1, 2"""))
def agg_interval_sum(t):
    span = F.sum(X.close_second(C("stop_s")) - C("start_s"))
    return t.schedules().groupBy("vendor_id", C("weekday").cast("bigint").alias("weekday")).agg(
        span.alias("open_s"), X.flag(span < 3 * 3600).alias("short_day"))


@query("agg_two_level", sql("""
WITH inner_max AS (SELECT tenant_id, COALESCE(CAST(chain_id AS VARCHAR), vendor_code) AS chain, vendor_code,
    MAX(accept_voucher) AS voucher, MAX(active_menus) AS menus FROM vendors GROUP BY 1, 2, 3)
SELECT tenant_id, chain, vendor_code, MAX(voucher) OVER (PARTITION BY tenant_id, chain) AS voucher,
  MAX(menus) OVER (PARTITION BY tenant_id, chain) AS menus FROM inner_max"""))
def agg_two_level(t):
    chain = F.coalesce(C("chain_id").cast("string"), C("vendor_code"))
    rows = t.vendors().select(
        "tenant_id", chain.alias("chain"), "vendor_code", C("accept_voucher").alias("voucher"), C("active_menus").alias("menus"))
    return aggregates.rollup_max(rows, ["vendor_code"], ["tenant_id", "chain"], ["voucher", "menus"])


define("product_totals", """
SELECT tenant_id, vendor_id, product, CAST(SUM(quantity) AS BIGINT) AS quantity FROM order_products GROUP BY 1, 2, 3""")


def product_totals(t):
    return t.order_products().groupBy("tenant_id", "vendor_id", "product").agg(F.sum("quantity").alias("quantity"))


@query("agg_pivot_rank_text", sql("""
SELECT vendor_id, """ + ", ".join(f"COALESCE(MAX(product) FILTER (WHERE r = {i}), '') AS title_{i}, "
    f"COALESCE(MAX(CAST(quantity AS VARCHAR)) FILTER (WHERE r = {i}), '') AS quant_{i}" for i in (1, 2, 3)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY quantity DESC, product) AS r FROM product_totals)
WHERE r <= 3 GROUP BY 1"""))
def agg_pivot_rank_text(t):
    best = ranking.top_n(product_totals(t), ["vendor_id"], "quantity", ["product"], 3)
    return aggregates.pivot_ranked(best, ["vendor_id"], "rank", {"product": "title", "quantity": "quant"}, 3)


FOUR_WEEKS = periods.last_weeks(AS_OF, 4)


@query("agg_week_pivot", sql(f"""
SELECT vendor_id, COUNT(order_id) AS orders, {R('CAST(SUM(gfv) AS DOUBLE)', 2)} AS gfv, """ + ", ".join(
    f"COUNT(order_id) FILTER (WHERE order_day BETWEEN DATE '2001-06-18' + {7 * w} AND DATE '2001-06-18' + {7 * w + 6}) AS orders_w_{w + 1}, "
    + R(f"CAST(SUM(gfv) FILTER (WHERE order_day BETWEEN DATE '2001-06-18' + {7 * w} AND DATE '2001-06-18' + {7 * w + 6}) AS DOUBLE)", 2)
    + f" AS gfv_w_{w + 1}" for w in range(4)) + f"""
FROM vendor_orders WHERE {between('order_day', FOUR_WEEKS)} GROUP BY 1"""))
def agg_week_pivot(t):
    orders = t.vendor_orders(FOUR_WEEKS.start, FOUR_WEEKS.end)
    return numbers(aggregates.period_pivot(
        orders, ["vendor_id"], "order_ts", FOUR_WEEKS.start, 4,
        {"orders": ("count", C("order_id")), "gfv": ("sum", C("gfv"))}), 2)


def regr_sql(kind: str, digits: int) -> str:
    fit = f"regr_{kind}(greatest(at_door_min - 2.4, 0), arrival_offset) FILTER (WHERE arrival_offset BETWEEN -8 AND 7)"
    return sql(f"SELECT vendor_id, {R(fit, digits)} AS {kind} FROM deliveries GROUP BY 1")


def regr_by_vendor(t, kind: str, digits: int):
    near = C("arrival_offset").between(-8, 7)
    waiting = F.greatest(C("at_door_min") - 2.4, F.lit(0.0))
    return t.deliveries().groupBy("vendor_id").agg(
        X.measure(X.regr(kind, waiting, C("arrival_offset"), near), digits).alias(kind))


@query("agg_regr_intercept", regr_sql("intercept", 4))
def agg_regr_intercept(t):
    return regr_by_vendor(t, "intercept", 4)


@query("agg_regr_slope", regr_sql("slope", 4))
def agg_regr_slope(t):
    return regr_by_vendor(t, "slope", 4)


@query("agg_distinct_rows", sql("SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders"))
def agg_distinct_rows(t):
    return aggregates.distinct_rows(t.raw("orders"), "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")


# -- windows ----------------------------------------------------------------------------------

define("vendor_sales", """
SELECT v.tenant_id, v.city_id, v.vendor_id, COALESCE(CAST(s.gmv AS DOUBLE), 0) AS gmv FROM vendors v
LEFT JOIN (SELECT vendor_id, SUM(gmv) AS gmv FROM vendor_orders GROUP BY 1) s ON s.vendor_id = v.vendor_id""")


def vendor_sales(t):
    sales = t.vendor_orders().groupBy("vendor_id").agg(F.sum("gmv").alias("gmv"))
    return t.vendors().select("tenant_id", "city_id", "vendor_id").join(sales, "vendor_id", "left").withColumn(
        "gmv", F.coalesce(C("gmv").cast("double"), F.lit(0.0)))


@query("win_ntile_city", sql("""
SELECT vendor_id, CASE WHEN ntile(100) OVER (PARTITION BY tenant_id, city_id ORDER BY gmv DESC, vendor_id) <= 2 THEN 1 ELSE 0 END AS top
FROM vendor_sales"""))
def win_ntile_city(t):
    return ranking.in_top_ntile(vendor_sales(t), ["tenant_id", "city_id"], "gmv", ["vendor_id"], 100, 2, "top").select(
        "vendor_id", "top")


@query("win_ntile_country", sql("""
SELECT vendor_id, CASE WHEN ntile(100) OVER (PARTITION BY tenant_id ORDER BY gmv DESC, vendor_id) <= 35 THEN 1 ELSE 0 END AS top
FROM vendor_sales"""))
def win_ntile_country(t):
    return ranking.in_top_ntile(vendor_sales(t), ["tenant_id"], "gmv", ["vendor_id"], 100, 35, "top").select("vendor_id", "top")


@query("win_latest_per_key", sql("""
SELECT account_id, record_type, opportunity_id, created_date, stage FROM (SELECT *, row_number() OVER (
  PARTITION BY account_id, record_type ORDER BY created_date DESC, opportunity_id DESC) AS r FROM opportunities) WHERE r = 1"""))
def win_latest_per_key(t):
    return ranking.latest(
        t.opportunities(), ["account_id", "record_type"], ["created_date", "opportunity_id"],
        ["opportunity_id", "created_date", "stage"])


@query("win_dedupe_first", sql("""
SELECT c_nationkey, c_mktsegment, c_name, c_mktsegment || '_1' AS subscriber_key FROM (SELECT *, row_number() OVER (
  PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1"""))
def win_dedupe_first(t):
    first = ranking.dedupe_first(t.raw("customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])
    return first.select("c_nationkey", "c_mktsegment", "c_name",
                        X.concat_strict(C("c_mktsegment"), F.lit("_1")).alias("subscriber_key"))


@query("win_top_n", sql("""
SELECT tenant_id, vendor_id, product, quantity, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, vendor_id ORDER BY quantity DESC, product) AS rank FROM product_totals) WHERE rank <= 5"""))
def win_top_n(t):
    return ranking.top_n(product_totals(t), ["tenant_id", "vendor_id"], "quantity", ["product"], 5)


@query("win_share_of_total", sql("""
SELECT vendor_id, product, CAST(floor(CAST(quantity / CAST(SUM(quantity) OVER (PARTITION BY vendor_id) AS DOUBLE) * 100
  AS DECIMAL(28,10)) * 10) AS DOUBLE) / 10 AS share FROM product_totals"""))
def win_share_of_total(t):
    return ranking.share(product_totals(t), ["vendor_id"], "quantity").select("vendor_id", "product", "share")


@query("win_nth_event", sql("""
SELECT vendor_id, order_day AS nth_day FROM (SELECT vendor_id, order_day, row_number() OVER (
  PARTITION BY vendor_id ORDER BY order_ts, order_id) AS r FROM vendor_orders) WHERE r = 25"""))
def win_nth_event(t):
    return ranking.nth_event(t.vendor_orders(), ["vendor_id"], "order_ts", 25)


@query("win_rank_global", sql("""
SELECT o_orderkey, rank() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice / 1000) END DESC NULLS FIRST) AS global_rank
FROM orders"""))
def win_rank_global(t):
    score = F.when(C("o_orderstatus") != "P", F.round(C("o_totalprice") / 1000))
    return ranking.global_rank(t.raw("orders").select("o_orderkey", score.alias("score")), "score").drop("score")


@query("win_rank_partition", sql("""
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rank FROM orders"""))
def win_rank_partition(t):
    return ranking.rank_in(t.raw("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                           ["o_orderpriority"], "o_totalprice").select("o_orderkey", "rank")


@query("win_partition_max", sql("SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders"))
def win_partition_max(t):
    return aggregates.with_group(t.raw("orders"), ["o_custkey"], {"top": F.max("o_totalprice")}).select("o_orderkey", "top")


@query("win_partition_count", sql("""
SELECT opportunity_id, COUNT(*) OVER (PARTITION BY owner, record_type) AS per_type FROM opportunities"""))
def win_partition_count(t):
    return aggregates.with_group(t.opportunities(), ["owner", "record_type"], {"per_type": F.count(F.lit(1))}).select(
        "opportunity_id", "per_type")


@query("win_running_count", sql("""
SELECT opportunity_id, COUNT(*) OVER (PARTITION BY owner, record_type ORDER BY CAST(floor(value / 1000) AS BIGINT) DESC) AS running_count
FROM opportunities"""))
def win_running_count(t):
    rows = t.opportunities().select("opportunity_id", "owner", "record_type", F.floor(C("value") / 1000).cast("bigint").alias("size"))
    return ranking.running_count(rows, ["owner", "record_type"], "size").select("opportunity_id", "running_count")


@query("win_running_sum_case_order", sql("""
SELECT opportunity_id, CAST(SUM(value) OVER (PARTITION BY owner ORDER BY
  CASE WHEN account_id >= 2001 - year(created_date) THEN account_id ELSE 2001 - year(created_date) END) AS DOUBLE) AS running_total FROM opportunities"""))
def win_running_sum_case_order(t):
    age = F.lit(2001) - F.year("created_date")
    rows = t.opportunities().withColumn("place", F.when(C("account_id") >= age, C("account_id")).otherwise(age))
    return ranking.running_sum(rows, ["owner"], "value", [asc("place")]).select(
        "opportunity_id", C("running_total").cast("double").alias("running_total"))


@query("win_row_number_owner", sql("""
SELECT opportunity_id, row_number() OVER (PARTITION BY owner ORDER BY value DESC, opportunity_id) AS row_no FROM opportunities"""))
def win_row_number_owner(t):
    rows = t.opportunities().select("owner", "opportunity_id", "value")
    return ranking.running(rows, ["owner"], [desc("value"), asc("opportunity_id")]).select("opportunity_id", "row_no")


# -- order, top-k, sets -----------------------------------------------------------------------

@query("sort_multi_key", sql("SELECT tenant_id, city_id, vendor_id, vendor_name FROM vendors"))
def sort_multi_key(t):
    rows = t.vendors().select("tenant_id", "city_id", "vendor_id", "vendor_name")
    return filters.sort_final(rows, "tenant_id", "city_id", C("vendor_id").desc())


@query("topk_rank_cut", sql("""
SELECT owner, opportunity_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY value DESC, opportunity_id) AS rank
  FROM opportunities) WHERE rank <= 400 AND stage = 'New' AND value >= 500"""))
def topk_rank_cut(t):
    best = ranking.top_n(t.opportunities(), ["owner"], "value", ["opportunity_id"], 400)
    return best.where((C("stage") == "New") & (C("value") >= 500)).select("owner", "opportunity_id", "rank")


@query("budget_cut", sql("""
SELECT owner, opportunity_id, CAST(running_total AS DOUBLE) AS running_total FROM (SELECT *, SUM(value) OVER (
  PARTITION BY owner ORDER BY value DESC) AS running_total FROM opportunities)
WHERE running_total <= 2000000 + 100000 * CAST(right(owner, 1) AS INTEGER)"""))
def budget_cut(t):
    budget = F.lit(2000000) + 100000 * F.substring("owner", -1, 1).cast("int")
    rows = t.opportunities().withColumn("budget", budget)
    return ranking.within_budget(rows, ["owner"], "value", [desc("value")], "budget").select(
        "owner", "opportunity_id", C("running_total").cast("double").alias("running_total"))


@query("set_union_all", sql("""
SELECT brand, city_id, COUNT(*) AS vendors FROM vendors WHERE vendor_active = 1 GROUP BY 1, 2"""))
def set_union_all(t):
    first, second = (t.vendors().where(C("brand") == b) for b in "AB")
    both = sets.union_brands([first, second]).where(C("vendor_active") == 1)
    return both.groupBy("brand", "city_id").agg(F.count(F.lit(1)).alias("vendors"))


@query("set_unpivot_union", sql("""
SELECT vendor_id, 'commission' AS kpi, CAST(commission_pct AS DOUBLE) AS score FROM contracts WHERE commission_pct < 0.3 AND commission_pct > 0.01
UNION ALL SELECT vendor_id, 'exclusivity', CAST(exclusivity AS DOUBLE) FROM contracts
UNION ALL SELECT vendor_id, 'FB', CAST(fb_rights AS DOUBLE) FROM contracts WHERE facebook_likes >= 5000
UNION ALL SELECT vendor_id, 'backlink', CAST(backlink AS DOUBLE) FROM contracts WHERE website IS NULL"""))
def set_unpivot_union(t):
    pct = C("commission_pct")
    kinds = {"commission": pct, "exclusivity": C("exclusivity"), "FB": C("fb_rights"), "backlink": C("backlink")}
    specs = [{"kpi": F.lit(kpi), "score": c.cast("double")} for kpi, c in kinds.items()]
    when = [(pct < 0.3) & (pct > 0.01), F.lit(True), C("facebook_likes") >= 5000, C("website").isNull()]
    return sets.unpivot(t.contracts(), ["vendor_id"], specs, when)
