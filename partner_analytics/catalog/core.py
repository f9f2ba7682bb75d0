"""Score card queries: KPIs, operations scores, monthly and weekly card."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partner_analytics import periods
from partner_analytics.catalog.oracle import R, define, sql
from partner_analytics.catalog.registry import query
from partner_analytics.functions import LADDERS, OPS_LADDERS, dish_score, facebook_score, ladder, measure, quadratic_score
from partner_analytics.plans import kpis, ops, scorecard
from partner_analytics.plans.weights import KPI_IMPACT
from partner_analytics.sources.tables import AS_OF, EVENTS_AS_OF

MONTH = periods.previous_month(AS_OF)
WEEK = periods.previous_week(AS_OF)
EVENT_MONTH = periods.fixed(date(2024, 1, 1), date(2024, 1, 31))
REPEAT_YEAR = periods.fixed(date(2000, 1, 1), date(2000, 12, 31))
REPEAT_DAYS = 365
PATTERNS = {
    "door_sticker": "red ring brand#1$", "voucher_cards": "small.*brand#2$", "display": "bolt brand#3$",
    "backlink": "promo brand#4$", "whitelabel": "medium brand#5$", "phase": "F",
}


def numbers(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all fractional columns, so that results compare exactly."""
    fractional = (T.DoubleType, T.DecimalType)
    return df.select(*[
        measure(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, fractional) else F.col(f.name)
        for f in df.schema.fields
    ])


def day(d: date) -> str:
    return f"DATE '{d}'"


def between(column: str, p) -> str:
    return f"{column} BETWEEN {day(p.start)} AND {day(p.end)}"


# -- building blocks of the oracle texts ------------------------------------------------------

for grain, p in (("month", MONTH), ("week", WEEK)):
    define(f"master_{grain}", f"""
SELECT DISTINCT v.tenant_id, v.city_id, vendor_id, vendor_code, vendor_name, city_name, country_name, owner,
  activation_date, '{p.label}' AS period
FROM vendors v JOIN cities c ON v.tenant_id = c.tenant_id AND v.city_id = c.city_id
JOIN countries co ON v.tenant_id = co.tenant_id
WHERE live = 1 AND city_active = 1 AND account_status = 'Active'""")

    define(f"kpis_{grain}", f"""
SELECT o.tenant_id, o.city_id, o.vendor_id, '{p.label}' AS period,
  COUNT(DISTINCT order_id) FILTER (WHERE valid_order = 1) AS valid_orders,
  COUNT(DISTINCT order_id) FILTER (WHERE gross_order = 1) AS gross_orders,
  COUNT(DISTINCT order_id) FILTER (WHERE failed_order_vendor = 1) AS failed_orders_vendor,
  COUNT(DISTINCT order_id) FILTER (WHERE valid_order = 1 AND expedition_type = 'pickup') AS pickup_orders,
  COUNT(DISTINCT order_id) FILTER (WHERE valid_order = 1 AND expedition_type <> 'pickup') AS delivery_orders,
  CAST(SUM(gmv) FILTER (WHERE valid_order = 1) AS DOUBLE) AS gmv,
  CAST(SUM(gfv) FILTER (WHERE valid_order = 1) AS DOUBLE) AS gfv,
  SUM(confirm_minutes) AS processing_time, COUNT(confirm_minutes) AS processing_time_count,
  COUNT(*) FILTER (WHERE list_has_any(code_array, [51,52,53,55,56,57,59,591,592])) AS actionable_orders,
  COUNT(*) FILTER (WHERE list_has_any(code_array, [51,52,53,55,56,57,59,591,592]) AND valid_order = 1)
    / NULLIF(CAST(COUNT(*) FILTER (WHERE valid_order = 1) AS DOUBLE), 0) AS automated_orders,
  COUNT(*) FILTER (WHERE vendor_late_min >= 5 AND courier_late_min < 5) AS vendor_delay_sum
FROM flagged_orders o JOIN cities c ON o.tenant_id = c.tenant_id AND o.city_id = c.city_id
WHERE {between('order_day', p)} AND NOT c.is_test
GROUP BY 1, 2, 3""")

    define(f"complaints_{grain}", f"""
SELECT o.tenant_id, o.vendor_id, COUNT(DISTINCT o.order_id) FILTER (WHERE regexp_matches(reason, '3D.', 'i')
    OR regexp_matches(reason, '3C.', 'i') OR regexp_matches(reason, '3B.', 'i')) AS complaints,
  COUNT(DISTINCT o.order_id) AS orders
FROM flagged_orders o LEFT JOIN contacts z ON z.tenant_id = o.tenant_id AND z.order_id = o.order_id
WHERE {between('order_day', p)} AND valid_order = 1 GROUP BY 1, 2""")

define("reorder_year", f"""
SELECT f.tenant_id, f.vendor_id,
  COUNT(DISTINCT CASE WHEN {day(AS_OF)} - first_day > {REPEAT_DAYS} THEN f.customer_id END) AS base_customers,
  COUNT(DISTINCT CASE WHEN {day(AS_OF)} - first_day > {REPEAT_DAYS} AND o.order_day - first_day > 0
    AND o.order_day - first_day <= {REPEAT_DAYS} AND o.vendor_id = f.vendor_id THEN f.customer_id END) AS repeat_customers
FROM (SELECT tenant_id, vendor_id, customer_id, MIN(order_day) AS first_day FROM flagged_orders
      WHERE valid_order = 1 AND {between('order_day', REPEAT_YEAR)} GROUP BY 1, 2, 3) f
LEFT JOIN flagged_orders o ON f.tenant_id = o.tenant_id AND f.customer_id = o.customer_id AND o.valid_order = 1
GROUP BY 1, 2""")

define("conversion_all", f"""
SELECT vendor_id, cr3 FROM (SELECT vendor_id, SUM(cr3_end) / NULLIF(CAST(SUM(cr3_start) AS DOUBLE), 0) AS cr3
  FROM funnel WHERE {between('report_date', EVENT_MONTH)} GROUP BY 1) WHERE cr3 IS NOT NULL""")

for name, p in (("nps_month", EVENT_MONTH),):
    define(name, f"""
SELECT o.tenant_id, o.city_id, o.vendor_id, CAST(COALESCE(ROUND(CAST(SUM(recommendation) / CAST(COUNT(recommendation) AS DOUBLE) AS DECIMAL(28,10)), 2), 0) AS DOUBLE) AS nps_packaging
FROM surveys n JOIN countries co ON upper(split_part(venture_name, '_', 2)) = country_iso
JOIN vendor_orders o ON o.tenant_id = co.tenant_id AND o.order_id = n.last_order_id
JOIN cities c ON c.tenant_id = o.tenant_id AND c.city_id = o.city_id
WHERE {between('submitted', p)} AND reason = 'Packaging' AND NOT is_test AND city_active = 1 GROUP BY 1, 2, 3""")

define("closing_all", """
SELECT vendor_id, SUM(COALESCE(closed_hours, 0)) / NULLIF(CAST(SUM(open_hours) AS DOUBLE), 0) AS closing_hours
FROM offline GROUP BY 1""")
define("closing_month", f"""
SELECT vendor_id, SUM(COALESCE(closed_hours, 0)) / NULLIF(CAST(SUM(open_hours) AS DOUBLE), 0) AS closing_hours
FROM offline WHERE {between('report_date', EVENT_MONTH)} GROUP BY 1""")

define("vendor_content", """
SELECT tenant_id, v.vendor_id, COALESCE(menucategories, 0) AS menucategories, COALESCE(products, 0) AS products,
  COALESCE(described, 0) AS described,
  COALESCE((products - described) / NULLIF(CAST(products AS DOUBLE), 0), 0) AS products_without_description
FROM vendors v LEFT JOIN content c ON v.vendor_id = c.vendor_id""")

define("marketing_all", f"""
SELECT c.vendor_id, commission_pct, flat_fee, price_mark_up, exclusivity, packaging_quality, fb_rights,
  facebook_likes, no_fb,
  COALESCE(MAX(1) FILTER (WHERE regexp_matches(product_name, '{PATTERNS["door_sticker"]}', 'i')), 0) AS door_sticker,
  COALESCE(MAX(1) FILTER (WHERE regexp_matches(product_name, '{PATTERNS["voucher_cards"]}', 'i')), 0) AS voucher_cards,
  COALESCE(MAX(1) FILTER (WHERE regexp_matches(product_name, '{PATTERNS["display"]}', 'i')), 0) AS display,
  COALESCE(MAX(1) FILTER (WHERE (regexp_matches(opportunity_type, '{PATTERNS["backlink"]}', 'i') AND phase = 'F')
    OR regexp_matches(opportunity_type, '{PATTERNS["whitelabel"]}', 'i') OR website IS NULL), 0) AS backlink
FROM contracts c LEFT JOIN crm_products o ON o.vendor_id = c.vendor_id
WHERE contract_status IN ('Activated', 'Amended') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""")

define("ops_orders_recent", f"""
SELECT o.tenant_id, o.vendor_id, o.city_id, o.order_id, order_ts AS ts, utilisation,
  CAST(ROUND(CAST(at_door_min AS DECIMAL(28,10)), 1) - CAST(2.4 AS DECIMAL(6,2)) AS DOUBLE) AS waiting_time,
  CAST(arrival_offset AS DOUBLE) AS arrival_offset, prep_min, CASE WHEN redelivery THEN 1 ELSE 0 END AS redelivery
FROM placed_orders o LEFT JOIN dispatch_orders p ON o.tenant_id = p.tenant_id AND o.order_id = p.order_id
LEFT JOIN courier_trips d ON p.tenant_id = d.tenant_id AND p.dispatch_id = d.dispatch_id AND d.trip_status = 'completed'
LEFT JOIN order_status s ON o.status_id = s.status_id
WHERE {day(EVENTS_AS_OF)} - CAST(order_ts AS DATE) <= 10 AND preorder = 0 AND valid_order = 1
  AND prep_min IS NOT NULL AND prep_buffer IS NOT NULL""")

define("ops_meta_all", f"""
SELECT v.tenant_id, v.vendor_id, v.vendor_code, v.city_id,
  {R("NULLIF(regr_intercept(greatest(waiting_time, 0), arrival_offset) FILTER (WHERE arrival_offset BETWEEN -8 AND 7), 'nan'::DOUBLE)", 1)} AS waiting_time_intercept,
  {R("NULLIF(regr_slope(greatest(waiting_time, 0), arrival_offset) FILTER (WHERE arrival_offset BETWEEN -8 AND 7), 'nan'::DOUBLE)", 2)} AS waiting_time_slope,
  {R("SUM(prep_min) FILTER (WHERE utilisation < 50) / NULLIF(CAST(COUNT(prep_min) FILTER (WHERE utilisation < 50) AS DOUBLE), 0)", 1)} AS prep_time_avg,
  {R("COUNT(waiting_time) FILTER (WHERE waiting_time > 5 AND arrival_offset BETWEEN -3 AND 7) / CAST(greatest(COUNT(order_id), 1) AS DOUBLE) * 100", 1)} AS reliability_rate,
  {R("SUM(redelivery) / NULLIF(CAST(COUNT(order_id) AS DOUBLE), 0) * 100", 3)} AS redelivery_rate,
  COUNT(order_id) AS orders_evaluated
FROM vendors v LEFT JOIN ops_orders_recent o ON v.tenant_id = o.tenant_id AND v.vendor_id = o.vendor_id
WHERE v.vendor_active = 1 GROUP BY 1, 2, 3, 4""")


def ladder_sql(expr: str, spec) -> str:
    """A CASE over the bands, first match wins."""
    arms = []
    for low, low_closed, high, high_closed, score in spec.bands:
        tests = []
        if low is not None:
            tests.append(f"({expr}) {'>=' if low_closed else '>'} CAST({low} AS DOUBLE)")
        if high is not None:
            tests.append(f"({expr}) {'<=' if high_closed else '<'} CAST({high} AS DOUBLE)")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {score}")
    other = "NULL" if spec.missing is None else spec.missing
    return f"CASE {' '.join(arms)} ELSE {other} END"


def penalty_sql(column: str, tolerance: float) -> str:
    return (f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} < {tolerance} THEN CAST(0 AS DOUBLE) "
            f"ELSE power({column} - CAST({tolerance} AS DOUBLE), 2) END")


define("ops_penalties", f"""
SELECT *, {R("waiting_penalty + prep_penalty + reliability_penalty")} AS overall_penalty FROM (
  SELECT *, {penalty_sql('waiting_time_intercept', 0.6)} AS waiting_penalty,
    {penalty_sql('prep_time_avg', 15)} AS prep_penalty, {penalty_sql('reliability_rate', 10)} AS reliability_penalty
  FROM ops_meta_all WHERE orders_evaluated > 10)""")

define("ops_scored", f"""
SELECT *, {ladder_sql('overall_penalty', OPS_LADDERS['overall'])} AS vendor_delay_score,
  {ladder_sql('reliability_penalty', OPS_LADDERS['reliability'])} AS reliability_score,
  {ladder_sql('prep_penalty', OPS_LADDERS['prep_time'])} AS prep_time_score,
  {ladder_sql('waiting_penalty', OPS_LADDERS['waiting'])} AS waiting_time_score,
  rank() OVER (ORDER BY overall_penalty DESC NULLS FIRST) AS global_rank,
  rank() OVER (PARTITION BY tenant_id ORDER BY overall_penalty DESC NULLS FIRST) AS country_rank
FROM ops_penalties""")

METRIC_COLUMNS = """
  d.tenant_id, d.city_id, d.vendor_id, d.vendor_code, d.vendor_name, d.city_name, d.country_name, d.owner,
  d.activation_date, d.period, valid_orders, gross_orders, pickup_orders, delivery_orders,
  failed_orders_vendor, actionable_orders, gmv, gfv,
  failed_orders_vendor / NULLIF(CAST(gross_orders AS DOUBLE), 0) AS cancellations,
  COALESCE(gfv / NULLIF(valid_orders, 0) * commission_pct, 0)
    + COALESCE(valid_orders * flat_fee, 0) / NULLIF(CAST(valid_orders AS DOUBLE), 0) AS revenue,
  gmv / NULLIF(valid_orders, 0) AS aov, gfv / NULLIF(valid_orders, 0) AS afv,
  1 - actionable_orders / NULLIF(CAST(valid_orders AS DOUBLE), 0) AS automation_gross,
  processing_time / NULLIF(CAST(processing_time_count AS DOUBLE), 0) AS processing_time,
  vendor_delay_sum / NULLIF(CAST(valid_orders AS DOUBLE), 0) AS vendor_delay,
  1 - automated_orders AS automated_orders_perc,
  COALESCE(repeat_customers / NULLIF(CAST(base_customers AS DOUBLE), 0), 0) AS reorder_rate,
  COALESCE(base_customers, 0) AS base_customers, COALESCE(repeat_customers, 0) AS repeat_customers,
  COALESCE(menucategories, 0) AS menucategories, COALESCE(products, 0) AS products,
  COALESCE(described, 0) AS described, COALESCE(products_without_description, 0) AS products_without_description,
  nps_packaging, COALESCE(packaging_quality, 0) AS packaging_quality, COALESCE(commission_pct, 0) AS commission_pct,
  COALESCE(price_mark_up, 0) AS price_mark_up, COALESCE(fb_rights, 0) AS fb_rights,
  COALESCE(m.facebook_likes, 0) AS facebook_likes, no_fb, COALESCE(door_sticker, 0) AS door_sticker,
  COALESCE(voucher_cards, 0) AS voucher_cards, COALESCE(display, 0) AS display, COALESCE(backlink, 0) AS backlink,
  COALESCE(exclusivity, 0) AS exclusivity, complaints, closing_hours, cl.gmv_class"""

for grain, terms, stage, cr3 in (
    ("month", "contracts", "photo_stage", "cr3"), ("week", "marketing_all", "7", "CAST(NULL AS DOUBLE)"),
):
    define(f"metrics_{grain}", f"""
SELECT *, CASE WHEN ntile(100) OVER (PARTITION BY tenant_id, city_id, period
    ORDER BY COALESCE(gmv, 0) DESC, vendor_id) <= 10 THEN 1 ELSE 0 END AS city_top,
  CASE WHEN ntile(100) OVER (PARTITION BY tenant_id, period
    ORDER BY COALESCE(gmv, 0) DESC, vendor_id) <= 35 THEN 1 ELSE 0 END AS country_top
FROM (SELECT {METRIC_COLUMNS}, {cr3} AS cr3,
    CASE WHEN m.vendor_id IS NULL THEN NULL ELSE {stage} END AS stage,
    {ladder_sql('m.facebook_likes', LADDERS['facebook_likes'])} AS likes_ladder,
    CASE WHEN m.facebook_likes IS NULL THEN NULL ELSE likes_ladder END AS facebook_likes_score
  FROM master_{grain} d
  LEFT JOIN kpis_{grain} f ON d.tenant_id = f.tenant_id AND d.vendor_id = f.vendor_id
  LEFT JOIN conversion_all c ON d.vendor_id = c.vendor_id
  LEFT JOIN reorder_year r ON d.tenant_id = r.tenant_id AND d.vendor_id = r.vendor_id
  LEFT JOIN {'closing_month' if grain == 'month' else 'closing_all'} h ON d.vendor_id = h.vendor_id
  LEFT JOIN vendor_content p ON d.vendor_id = p.vendor_id
  LEFT JOIN nps_month n ON d.tenant_id = n.tenant_id AND d.vendor_id = n.vendor_id
  LEFT JOIN {terms} m ON d.vendor_id = m.vendor_id
  LEFT JOIN gmv_classes cl ON cl.tenant_id = d.tenant_id AND cl.vendor_code = d.vendor_code AND cl.company IN ('First')
  LEFT JOIN complaints_{grain} z ON d.tenant_id = z.tenant_id AND d.vendor_id = z.vendor_id)""")

    ladders = ", ".join(
        f"{ladder_sql(c, LADDERS[name])} AS {name}_score" for name, c in {
            "commission": "commission_pct", "cr3": "cr3", "price_mark_up": "price_mark_up",
            "packaging_quality": "packaging_quality", "reorder_rate": "reorder_rate",
            "menucategories": "menucategories", "products": "products",
            "products_without_description": "products_without_description",
            "automation": "automated_orders_perc", "cancellations": "cancellations",
            "processing_time": "processing_time", "revenue": "revenue", "closing_hours": "closing_hours",
            "customer_complaints": "complaints / NULLIF(CAST(valid_orders AS DOUBLE), 0)"}.items())
    flags = ", ".join(f"CASE {c} WHEN 0 THEN 0 WHEN 1 THEN 10 END AS {c}_score" for c in (
        "door_sticker", "voucher_cards", "display", "backlink", "exclusivity"))
    dish = ("10" if grain == "week" else
            "CASE WHEN city_top = 0 AND country_top = 0 THEN 10 WHEN stage IN (4, 5, 7) THEN 10 "
            "WHEN stage IN (1, 6) OR stage IS NULL THEN 0 WHEN stage = 2 THEN 5 WHEN stage = 3 THEN 7 ELSE 10 END")
    define(f"scored_{grain}", f"""
SELECT m.*, {ladders}, {flags},
  CASE WHEN no_fb = 1 THEN 10 WHEN city_top = 1 AND fb_rights = 0 THEN 0 WHEN fb_rights = 1 THEN 10
    ELSE COALESCE(facebook_likes_score, 0) END AS facebook_score,
  complaints / NULLIF(CAST(valid_orders AS DOUBLE), 0) AS complaint_rate, {dish} AS dish_level_score,
  COALESCE(o.vendor_delay_score, 10) AS vendor_delay_score, o.reliability_score, o.prep_time_score,
  o.waiting_time_score, o.waiting_time_intercept, o.prep_time_avg, o.reliability_rate
FROM metrics_{grain} m LEFT JOIN ops_scored o ON m.tenant_id = o.tenant_id AND m.vendor_id = o.vendor_id
WHERE valid_orders > 0""")


def stated(text: str) -> dict:
    """Weights written as "name weight name weight ..."."""
    words = text.split()
    return dict(zip(words[::2], words[1::2]))


# The definitions state their weights themselves, apart from the implementation's.
STATED = {
    "commercial": stated("revenue 0.8 price_mark_up 0.1 exclusivity 0.1"),
    "marketing": stated("facebook 0.35 door_sticker 0.1 voucher_cards 0.1 display 0.1 backlink 0.35"),
    "conversion": stated("reorder_rate 0.2 cr3 0.8"),
    "content": stated("menucategories 0.33 products 0.33 products_without_description 0.34"),
    "ops": stated("packaging_quality 0.1 automation 0.15 cancellations 0.15 vendor_delay 0.6"),
    "ops_final": stated("packaging_quality 0.2 automation 0.2 cancellations 0.1 processing_time 0.1 vendor_delay 0.4"),
}
STATED_AREAS = stated("commercial 0.2 marketing 0.2 conversion 0.1 content 0.1 ops 0.4")
STATED_IMPACT = {name: (area, weight) for area, weights in {
    "0.3": stated("revenue 0.6 price_mark_up 0.1 exclusivity 0.15"),
    "0.2": stated("facebook 0.35 backlink 0.35 display 0.05 door_sticker 0.05"),
    "0.05": stated("reorder_rate 0.2 cr3 0.8 menucategories 0.33 products 0.33 products_without_description 0.34"),
    "0.4": stated("packaging_quality 0 automation 0.1 cancellations 0.15 processing_time 0 closing_hours 0.1 customer_complaints 0.15"),
    "0.0": stated("vendor_delay 0.5"),
}.items() for name, weight in weights.items()}


def weighted_sql(weights: dict) -> str:
    return "(" + " + ".join(f"CAST({w} AS DOUBLE) * {name}_score" for name, w in weights.items()) + ")"


def areas_sql(ops: str) -> str:
    return "(" + " + ".join(
        f"CAST({w} AS DOUBLE) * {weighted_sql(STATED[ops if name == 'ops' else name])}" for name, w in STATED_AREAS.items()) + ")"


for grain in ("month", "week"):
    define(f"card_{grain}", f"""
SELECT *, {weighted_sql(STATED['commercial'])} AS commercial, {weighted_sql(STATED['marketing'])} AS marketing,
  {weighted_sql(STATED['conversion'])} AS conversion, {weighted_sql(STATED['content'])} AS content_score_area,
  {weighted_sql(STATED['ops'])} AS ops, {areas_sql('ops_final')} AS final_business,
  (10 - {areas_sql('ops')}) * gmv AS impact,
  CASE WHEN {day(AS_OF)} - activation_date >= 90 THEN 1 ELSE 0 END AS three_month_flag
FROM scored_{grain}""")


# -- bindings ---------------------------------------------------------------------------------

METRIC_ARGS = dict(as_of=AS_OF, reorder_period=REPEAT_YEAR, reorder_days=REPEAT_DAYS, events_period=EVENT_MONTH)
CARD_ARGS = dict(METRIC_ARGS, events_as_of=EVENTS_AS_OF)


def monthly_card(t) -> DataFrame:
    return scorecard.scorecard(t, "month", MONTH, **CARD_ARGS)


def weekly_card(t) -> DataFrame:
    return scorecard.scorecard(t, "week", WEEK, marketing_patterns=PATTERNS, **CARD_ARGS)


@query("rpt_vendor_master", sql("SELECT * FROM master_month"))
def rpt_vendor_master(t):
    return kpis.vendor_master(t, MONTH)


@query("rpt_valid_orders", sql(f"""
SELECT tenant_id, vendor_id, order_id, customer_id, order_day, {R('gmv', 2)} AS gmv
FROM flagged_orders WHERE valid_order = 1"""))
def rpt_valid_orders(t):
    return kpis.valid_orders(t).select(
        "tenant_id", "vendor_id", "order_id", "customer_id", F.to_date("order_ts").alias("order_day"),
        measure(F.col("gmv"), 2).alias("gmv"))


KPI_SQL = f"""
SELECT tenant_id, city_id, vendor_id, period, valid_orders, gross_orders, failed_orders_vendor, pickup_orders,
  delivery_orders, {R('gmv')} AS gmv, {R('gfv')} AS gfv, {R('processing_time')} AS processing_time,
  processing_time_count, actionable_orders, {R('automated_orders')} AS automated_orders, vendor_delay_sum FROM """


@query("rpt_order_kpis", sql(KPI_SQL + "kpis_month"))
def rpt_order_kpis(t):
    return numbers(kpis.order_kpis(t, MONTH))


@query("rpt_conversion_rate", sql(f"SELECT tenant_id, vendor_id, {R('cr3')} AS cr3 FROM conversion_all LEFT JOIN home USING (vendor_id)"))
def rpt_conversion_rate(t):
    return numbers(kpis.conversion(t, EVENT_MONTH))


@query("rpt_reorder_rate", sql(f"""
SELECT tenant_id, vendor_id, base_customers, repeat_customers,
  {R('COALESCE(repeat_customers / NULLIF(CAST(base_customers AS DOUBLE), 0), 0)')} AS reorder_rate FROM reorder_year"""))
def rpt_reorder_rate(t):
    return numbers(kpis.reorder(t, REPEAT_YEAR, AS_OF, REPEAT_DAYS))


@query("rpt_complaint_rate", sql(f"""
SELECT tenant_id, vendor_id, complaints, orders, {R('complaints / CAST(orders AS DOUBLE)')} AS complaint_rate
FROM complaints_month"""))
def rpt_complaint_rate(t):
    return numbers(kpis.complaints(t, MONTH))


@query("rpt_packaging_nps", sql("SELECT * FROM nps_month"))
def rpt_packaging_nps(t):
    return kpis.nps(t, EVENT_MONTH)


@query("rpt_closing_ratio", sql(f"""
SELECT tenant_id, vendor_id, {R('closing_hours')} AS closing_hours FROM closing_month LEFT JOIN home USING (vendor_id)"""))
def rpt_closing_ratio(t):
    return numbers(kpis.closing(t, EVENT_MONTH))


@query("rpt_product_content", sql(f"""
SELECT tenant_id, vendor_id, menucategories, products, described,
  {R('products_without_description')} AS products_without_description FROM vendor_content"""))
def rpt_product_content(t):
    return numbers(kpis.content(t))


@query("rpt_marketing_attrs", sql(f"""
SELECT tenant_id, vendor_id, {R('commission_pct')} AS commission_pct, flat_fee, price_mark_up, exclusivity, packaging_quality,
  fb_rights, facebook_likes, no_fb, door_sticker, voucher_cards, display, backlink FROM marketing_all LEFT JOIN home USING (vendor_id)"""))
def rpt_marketing_attrs(t):
    return numbers(kpis.marketing(t, PATTERNS))


METRIC_NAMES = """tenant_id city_id vendor_id vendor_code vendor_name city_name country_name owner activation_date
period valid_orders gross_orders pickup_orders delivery_orders failed_orders_vendor actionable_orders base_customers
repeat_customers menucategories products described packaging_quality price_mark_up fb_rights facebook_likes no_fb
door_sticker voucher_cards display backlink exclusivity complaints stage gmv_class facebook_likes_score city_top country_top""".split()
METRIC_NUMBERS = """gmv gfv cancellations revenue aov afv automation_gross processing_time vendor_delay
automated_orders_perc reorder_rate cr3 products_without_description nps_packaging commission_pct closing_hours""".split()
SCORE_NAMES = [f"{n}_score" for n in """commission cr3 price_mark_up packaging_quality reorder_rate menucategories
products products_without_description automation cancellations processing_time revenue closing_hours
customer_complaints door_sticker voucher_cards display backlink exclusivity facebook dish_level vendor_delay
reliability prep_time waiting_time""".split()]


def pick(names, rounded) -> str:
    return ", ".join([*names, *[f"{R(n)} AS {n}" for n in rounded]])


@query("rpt_final_metrics", sql(f"SELECT {pick(METRIC_NAMES, METRIC_NUMBERS)} FROM metrics_month"))
def rpt_final_metrics(t):
    return numbers(scorecard.metrics(t, MONTH, **METRIC_ARGS))


@query("rpt_score_ladder", sql(f"""
SELECT tenant_id, vendor_id, {', '.join(SCORE_NAMES)} FROM scored_month"""))
def rpt_score_ladder(t):
    return monthly_card(t).select("tenant_id", "vendor_id", *SCORE_NAMES)


@query("rpt_facebook_score", sql(f"""
SELECT tenant_id, vendor_id, CASE WHEN no_fb = 1 THEN 10 WHEN city_top = 1 AND fb_rights = 0 THEN 0
  WHEN fb_rights = 1 THEN 10 ELSE COALESCE(facebook_likes_score, 0) END AS facebook_score FROM metrics_month"""))
def rpt_facebook_score(t):
    wide = scorecard.metrics(t, MONTH, **METRIC_ARGS)
    score = facebook_score(F.col("no_fb"), F.col("city_top"), F.col("fb_rights"), F.col("facebook_likes_score"))
    return wide.select("tenant_id", "vendor_id", score.alias("facebook_score"))


@query("rpt_dish_level_score", sql("""
SELECT tenant_id, vendor_id, CASE WHEN city_top = 0 AND country_top = 0 THEN 10 WHEN stage IN (4, 5, 7) THEN 10
  WHEN stage IN (1, 6) OR stage IS NULL THEN 0 WHEN stage = 2 THEN 5 WHEN stage = 3 THEN 7 ELSE 10 END AS dish_level_score
FROM metrics_month"""))
def rpt_dish_level_score(t):
    wide = scorecard.metrics(t, MONTH, **METRIC_ARGS)
    score = dish_score(F.col("city_top"), F.col("country_top"), F.col("stage"))
    return wide.select("tenant_id", "vendor_id", score.alias("dish_level_score"))


@query("rpt_ops_order_data", sql("SELECT * FROM ops_orders_recent"))
def rpt_ops_order_data(t):
    return ops.ops_orders(t, EVENTS_AS_OF)


@query("rpt_ops_meta", sql("SELECT * FROM ops_meta_all"))
def rpt_ops_meta(t):
    return ops.ops_meta(t, EVENTS_AS_OF)


@query("rpt_ops_scores", sql(f"""
SELECT tenant_id, vendor_id, vendor_code, city_id, waiting_time_intercept, waiting_time_slope, prep_time_avg,
  reliability_rate, redelivery_rate, orders_evaluated, {R('waiting_penalty')} AS waiting_penalty,
  {R('prep_penalty')} AS prep_penalty, {R('reliability_penalty')} AS reliability_penalty, overall_penalty,
  vendor_delay_score, reliability_score, prep_time_score, waiting_time_score, global_rank, country_rank
FROM ops_scored"""))
def rpt_ops_scores(t):
    return numbers(ops.ops_scores(t, EVENTS_AS_OF))


@query("udf_quadratic_score", sql(f"""
SELECT delivery_id, {R('CASE WHEN at_door_min > 2.5 THEN 2 * power(at_door_min - 2.5, 2) ELSE 0 END', 4)} AS score
FROM deliveries"""))
def udf_quadratic_score(t):
    return t.deliveries().select(
        "delivery_id", measure(quadratic_score(F.col("at_door_min"), 2.5, 2), 4).alias("score"))


COMPOSITES = ["commercial", "marketing", "conversion", "content", "ops", "final_business"]
COMPOSITE_SQL = ", ".join(
    f"{R('content_score_area' if c == 'content' else c)} AS {c}" for c in COMPOSITES)


@query("rpt_composite_scores", sql(f"SELECT tenant_id, vendor_id, {COMPOSITE_SQL} FROM card_month"))
def rpt_composite_scores(t):
    return numbers(monthly_card(t).select("tenant_id", "vendor_id", *COMPOSITES))


@query("rpt_impact", sql(f"""
SELECT tenant_id, vendor_id, {R('impact', 4)} AS impact, three_month_flag FROM card_month"""))
def rpt_impact(t):
    return numbers(monthly_card(t).select("tenant_id", "vendor_id", "impact", "three_month_flag"), 4)


def card_sql(grain: str) -> str:
    rounded = [*METRIC_NUMBERS, "complaint_rate", "impact"]
    return sql(f"""SELECT {pick([*METRIC_NAMES, *SCORE_NAMES, 'three_month_flag', 'waiting_time_intercept',
        'prep_time_avg', 'reliability_rate'], [])}, {', '.join(f"{R(n, 4)} AS {n}" for n in rounded)},
        {', '.join(f"{R('content_score_area' if c == 'content' else c, 4)} AS {c}" for c in COMPOSITES)}
        FROM card_{grain}""")


@query("rpt_scorecard", card_sql("month"))
def rpt_scorecard(t):
    return numbers(monthly_card(t), 4)


@query("rpt_scorecard_weekly", card_sql("week"))
def rpt_scorecard_weekly(t):
    return numbers(weekly_card(t), 4)


define("kpi_impacts_month", "SELECT tenant_id, vendor_id, " + ", ".join(
    f"CAST({area} AS DOUBLE) * CAST({weight} AS DOUBLE) * gmv * (10 - {name}_score) AS {name}_impact"
    for name, (area, weight) in STATED_IMPACT.items()) + " FROM scored_month")


@query("rpt_impact_by_kpi", sql("SELECT tenant_id, vendor_id, " + ", ".join(
    f"{R(f'{name}_impact', 4)} AS {name}_impact" for name in STATED_IMPACT) + " FROM kpi_impacts_month"))
def rpt_impact_by_kpi(t):
    card = scorecard.kpi_impact(monthly_card(t))
    return numbers(card.select("tenant_id", "vendor_id", *[f"{name}_impact" for name in KPI_IMPACT]), 4)
