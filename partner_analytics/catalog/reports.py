"""Newsletter, delay, audit, stock, deal and ramp-up queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from partner_analytics import periods
from partner_analytics.catalog.core import MONTH, between, day, numbers
from partner_analytics.catalog.oracle import R, define, sql
from partner_analytics.catalog.registry import query
from partner_analytics.functions import measure
from partner_analytics.plans import audit, deals, delay, newsletter, ramp, stock
from partner_analytics.plans.opportunities import MATERIAL
from partner_analytics.sources.lookups import CUISINES
from partner_analytics.sources.tables import AS_OF, EVENTS_AS_OF, inline

C = F.col
COHORT_DAY = date(1995, 4, 25)
FOUR_WEEKS = periods.last_weeks(AS_OF, 4)
EXCLUDED = ["anvil", "^small w"]
OFFLINE_START = date(2024, 1, 1)
DELAY_PERIOD = periods.last_weeks(EVENTS_AS_OF, 8)
W = ["", "_w_1", "_w_2", "_w_3", "_w_4"]


def D(expr: str, n: int) -> str:
    """Rounded to n decimals, half away from zero, as double."""
    return R(expr, n)


# -- newsletter -------------------------------------------------------------------------------

@query("rpt_new_vendor_cohort", sql(f"""
SELECT v.tenant_id, COUNT(*) AS new_vendors, country_name FROM vendors v JOIN countries c ON v.tenant_id = c.tenant_id
WHERE account_status = 'Active' AND activation_date BETWEEN {day(COHORT_DAY)} - INTERVAL 6 WEEK AND {day(COHORT_DAY)} - INTERVAL 5 WEEK - INTERVAL 1 DAY
GROUP BY 1, 3"""))
def rpt_new_vendor_cohort(t):
    return newsletter.new_vendors(t, COHORT_DAY)


@query("rpt_delay_clean", sql("""
WITH late AS (
  SELECT p.tenant_id, p.order_id, CASE WHEN (CASE WHEN NOT redelivery THEN courier_late_min END) < 0 THEN pickup_delay_min
    WHEN (CASE WHEN NOT redelivery THEN courier_late_min END) BETWEEN 0 AND 10 THEN pickup_delay_min - courier_late_min END AS late
  FROM dispatch_orders p LEFT JOIN courier_trips d ON p.tenant_id = d.tenant_id AND p.dispatch_id = d.dispatch_id
  WHERE d.trip_status = 'completed' AND date_trunc('week', created_ts) >= date_trunc('week', DATE '2024-01-24'))
SELECT o.tenant_id, o.vendor_id, strftime(order_ts, '%G-%V') AS week, COUNT(DISTINCT o.order_id) AS valid_orders,
  COUNT(DISTINCT o.order_id) FILTER (WHERE late > 5) AS late_over_5_min,
  COUNT(DISTINCT o.order_id) FILTER (WHERE late > 10) AS late_over_10_min,
  COUNT(DISTINCT o.order_id) FILTER (WHERE late IS NOT NULL) AS delay_observations
FROM placed_orders o LEFT JOIN late h ON o.tenant_id = h.tenant_id AND o.order_id = h.order_id
LEFT JOIN order_status s ON o.status_id = s.status_id
WHERE valid_order = 1 AND date_trunc('week', order_ts) >= date_trunc('week', DATE '2024-01-24') GROUP BY 1, 2, 3"""))
def rpt_delay_clean(t):
    return newsletter.clean_delay(t, EVENTS_AS_OF)


define("issues_per_order", f"""
SELECT o.tenant_id, o.vendor_id, o.order_id, o.order_day, valid_order, failed_order_vendor, CAST(o.gfv AS DOUBLE) AS gfv,
  first_order, tracked, CASE WHEN vendor_late_min > 5 THEN vendor_late_min END AS vendor_late,
  CASE WHEN list_contains(code_array, 53) THEN 1 ELSE 0 END AS overdue,
  COALESCE(MAX(1) FILTER (WHERE valid_order = 1 AND regexp_matches(reason, '3B.', 'i')), 0) AS missing,
  COALESCE(MAX(1) FILTER (WHERE valid_order = 1 AND regexp_matches(reason, '3C.', 'i')), 0) AS wrong,
  COALESCE(MAX(1) FILTER (WHERE valid_order = 1 AND regexp_matches(reason, '3E.', 'i')), 0) AS damaged
FROM flagged_orders o LEFT JOIN contacts z ON z.tenant_id = o.tenant_id AND z.order_id = o.order_id
WHERE gross_order = 1 AND {between('o.order_day', FOUR_WEEKS)} GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11""")


@query("rpt_order_issue_flags", sql(f"""
SELECT tenant_id, vendor_id, order_id, order_day, valid_order, failed_order_vendor, {R('gfv', 4)} AS gfv, first_order, tracked,
  vendor_late, overdue, missing, wrong, damaged FROM issues_per_order"""))
def rpt_order_issue_flags(t):
    return numbers(newsletter.order_issues(t, FOUR_WEEKS), 4)


define("dishes_month", f"""
SELECT tenant_id, vendor_id, {', '.join(
    f"COALESCE(MAX(product) FILTER (WHERE r = {i}), '') AS title_{i}, "
    f"COALESCE(MAX(CAST(perc AS VARCHAR)) FILTER (WHERE r = {i}), '') AS quant_{i}" for i in range(1, 6))},
  CAST(SUM(perc) AS DOUBLE) AS total_perc
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, vendor_id ORDER BY quantity DESC, product) AS r,
    CAST(floor(CAST(quantity / CAST(SUM(quantity) OVER (PARTITION BY tenant_id, vendor_id) AS DOUBLE) * 100 AS DECIMAL(28,10)) * 10) / 10 AS DECIMAL(6,1)) AS perc
  FROM (SELECT tenant_id, vendor_id, product, SUM(quantity) AS quantity FROM order_products p
    JOIN order_status s ON p.status_id = s.status_id WHERE valid_order = 1 AND {between('order_day', MONTH)}
      AND NOT regexp_matches(product, 'anvil') AND NOT regexp_matches(product, '^small w') GROUP BY 1, 2, 3))
WHERE r <= 5 GROUP BY 1, 2""")


@query("rpt_top_dishes", sql("SELECT * FROM dishes_month"))
def rpt_top_dishes(t):
    return newsletter.top_dishes(t, MONTH, EXCLUDED)


KPI_CONDITIONS = {
    "valid_orders": "valid_order = 1", "declined_orders": "failed_order_vendor = 1", "missing_items": "missing = 1",
    "wrong_items": "wrong = 1", "damaged_packaging": "damaged = 1", "vendor_late": "vendor_late IS NOT NULL",
}
WEEK_BOUNDS = {"": "TRUE"} | {
    f"_w_{w + 1}": f"order_day BETWEEN DATE '2001-06-18' + {7 * w} AND DATE '2001-06-18' + {7 * w + 6}" for w in range(4)}
define("weekly_vendor", f"""
SELECT tenant_id, vendor_id, {', '.join(
    f"COUNT(*) FILTER (WHERE {cond} AND {inside}) AS {name}{s}" for name, cond in KPI_CONDITIONS.items() for s, inside in WEEK_BOUNDS.items())},
  CAST(SUM(CAST(gfv AS DECIMAL(20,4))) FILTER (WHERE valid_order = 1) AS DOUBLE) AS gmv_local,
  CAST(SUM(CAST(gfv AS DECIMAL(20,4))) FILTER (WHERE valid_order = 1) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE valid_order = 1), 0) AS afv,
  CAST(SUM(CAST(gfv AS DECIMAL(20,4))) FILTER (WHERE failed_order_vendor = 1) AS DOUBLE) AS lost_gfv,
  COUNT(*) FILTER (WHERE overdue = 1) AS overdue_orders, COUNT(*) FILTER (WHERE first_order = 1) AS new_customers,
  COUNT(*) FILTER (WHERE tracked) AS tracked_orders
FROM issues_per_order GROUP BY 1, 2""")
WEEKLY_COUNTS = [f"{name}{s}" for name in KPI_CONDITIONS for s in WEEK_BOUNDS]


@query("rpt_weekly_vendor_agg", sql(f"""
SELECT tenant_id, vendor_id, {', '.join(WEEKLY_COUNTS)}, {D('gmv_local', 4)} AS gmv_local, {D('afv', 4)} AS afv,
  {D('lost_gfv', 4)} AS lost_gfv, overdue_orders, new_customers, tracked_orders FROM weekly_vendor"""))
def rpt_weekly_vendor_agg(t):
    return numbers(newsletter.vendor_weeks(t, FOUR_WEEKS), 4)


define("offline_weeks", f"""
SELECT vendor_id, CAST(SUM(closed_hours) - SUM(declined_hours) AS BIGINT) AS offline_hours, CAST(SUM(open_hours) AS BIGINT) AS open_hours,
  {', '.join(f"CAST(SUM(closed_hours - declined_hours) FILTER (WHERE report_date BETWEEN DATE '2024-01-01' + {7 * w} AND DATE '2024-01-01' + {7 * w + 6}) AS BIGINT) AS offline_hours_w_{w + 1}" for w in range(4))}
FROM offline WHERE closed_hours < open_hours AND closed_hours > 0 GROUP BY 1""")


@query("rpt_offline_hours", sql("SELECT * FROM offline_weeks LEFT JOIN home USING (vendor_id)"))
def rpt_offline_hours(t):
    return newsletter.offline_hours(t, OFFLINE_START)


define("banner_all", f"""
SELECT tenant_id, vendor_id, CASE {' '.join(
    f"WHEN cuisine_id IN ({', '.join(map(str, ids))}) THEN '{kind}_banner.jpg'" for kind, ids in CUISINES.items())}
  ELSE 'european_banner.jpg' END AS banner FROM vendors WHERE vendor_active = 1 AND vendor_deleted = 0""")


@query("rpt_vendor_banner", sql("SELECT * FROM banner_all"))
def rpt_vendor_banner(t):
    return newsletter.banner(t)


define("prep_all", """
SELECT tenant_id, v.vendor_id, CASE WHEN AVG(prep_setting) IS NULL THEN CASE WHEN MAX(pickup_time) < 5 THEN 10 ELSE MAX(pickup_time) END
  ELSE CAST(SUM(prep_setting) AS DOUBLE) / COUNT(prep_setting) END AS prep_time_avg
FROM vendors v LEFT JOIN deliveries d ON v.vendor_id = d.vendor_id GROUP BY 1, 2""")


@query("rpt_prep_time", sql(f"SELECT tenant_id, vendor_id, {R('prep_time_avg')} AS prep_time_avg FROM prep_all"))
def rpt_prep_time(t):
    return numbers(newsletter.prep_time(t))


BENCH_SQL = "CASE WHEN {c} >= 12 AND {c} < 15 THEN {c} - 2 WHEN {c} < 12 THEN 10 ELSE 15 END"


@query("rpt_prep_benchmark", sql(f"""
SELECT tenant_id, vendor_id, {R(BENCH_SQL.format(c='prep_time_avg'))} AS prep_time_benchmark FROM prep_all"""))
def rpt_prep_benchmark(t):
    rows = newsletter.prep_time(t)
    return rows.select("tenant_id", "vendor_id", measure(newsletter.prep_benchmark(C("prep_time_avg"))).alias("prep_time_benchmark"))


define("contact_first", """
SELECT vendor_code, email, vendor_code || '_1' AS contact_key FROM (SELECT *, row_number() OVER (
  PARTITION BY vendor_code ORDER BY contact_id) AS r FROM newsletter_contacts WHERE excluded = 0) WHERE r = 1""")


def tracked_share(c: str) -> str:
    return f"CASE WHEN tracked_orders > 0 AND {c} > 0 THEN {D(f'({c}) / CAST(tracked_orders AS DOUBLE)', 2)} ELSE CAST(0 AS DOUBLE) END"


define("sendout_all", f"""
SELECT *, CASE WHEN prep_time_avg >= 12 AND prep_time_avg < 15 THEN prep_time_avg - 2 WHEN prep_time_avg < 12 THEN 10
    ELSE 15 END AS prep_time_benchmark FROM (
SELECT '{FOUR_WEEKS.label}' AS period, v.tenant_id, v.vendor_id, v.vendor_code, v.vendor_name, city_name, country_name,
  country_iso || '_' || COALESCE(contact_key, v.vendor_code) AS subscriber_key, COALESCE(email, backend_email) AS email, banner,
  {D('afv', 0)} AS afv, new_customers,
  CASE WHEN valid_orders <= 10 AND prep_time_avg < 10 THEN CAST(10 AS DOUBLE) ELSE {D('prep_time_avg', 0)} END AS prep_time_avg,
  {', '.join(f"{c}{s}" for c in ('valid_orders', 'vendor_late', 'declined_orders', 'damaged_packaging') for s in W)},
  CAST(trunc(CAST(gmv_local AS DECIMAL(28,10)) * 100) / 100 AS DOUBLE) AS gmv_local,
  {D('vendor_late / CAST(valid_orders AS DOUBLE)', 2)} AS vendor_late_percentage,
  {', '.join(f"{p}_{i}" for p in ('title', 'quant') for i in range(1, 6))}, total_perc,
  COALESCE(lost_gfv, 0) AS declined_gmv, overdue_orders,
  {', '.join(f"wrong_items{s} + missing_items{s} AS missing_wrong_items{s}" for s in W)},
  {', '.join(f"wrong_items{s} + missing_items{s} + damaged_packaging{s} AS cust_compl{s}" for s in W)},
  {tracked_share('(wrong_items + missing_items)')} AS missing_wrong_percentage,
  {tracked_share('damaged_packaging')} AS damaged_packaging_percentage, {tracked_share('declined_orders')} AS cancel_order_perc,
  {', '.join(f"COALESCE(offline_hours{s}, 0) AS offline_hours{s}" for s in W)}
FROM vendors v JOIN weekly_vendor d ON v.vendor_id = d.vendor_id
LEFT JOIN prep_all p ON v.vendor_id = p.vendor_id LEFT JOIN banner_all b ON v.vendor_id = b.vendor_id
LEFT JOIN dishes_month td ON v.vendor_id = td.vendor_id
LEFT JOIN cities ci ON v.tenant_id = ci.tenant_id AND v.city_id = ci.city_id
LEFT JOIN countries co ON v.tenant_id = co.tenant_id LEFT JOIN contact_first e ON e.vendor_code = v.vendor_code
LEFT JOIN offline_weeks o ON o.vendor_id = v.vendor_id
WHERE v.vendor_active = 1 AND v.vendor_deleted = 0 AND valid_orders > 0)""")


def sendout(t):
    return newsletter.sendout(t, FOUR_WEEKS, OFFLINE_START, MONTH, EXCLUDED)


SENT_ROUNDED = "SELECT * REPLACE (" + f"{R('declined_gmv', 4)} AS declined_gmv, {R('prep_time_benchmark', 4)} AS prep_time_benchmark)"


@query("rpt_newsletter", sql(f"{SENT_ROUNDED} FROM sendout_all WHERE email IS NOT NULL AND banner IS NOT NULL"))
def rpt_newsletter(t):
    return numbers(newsletter.newsletter(t, FOUR_WEEKS, OFFLINE_START, MONTH, EXCLUDED), 4)


def hash_noise(low: float, high: float, seed: int) -> str:
    digest = f"md5(concat_ws('|', tenant_id, period, city_name) || '#{seed}')"
    return f"({low} + CAST({high - low} AS DOUBLE) * (CAST('0x' || substr({digest}, 1, 8) AS BIGINT) / 4294967296.0))"


def halved(c: str) -> str:
    return f"CASE WHEN {c} > 6 THEN 3 WHEN {c} > 3 THEN {D(f'{c} * 0.5', 0)} ELSE {c} END"


def bench_share(c: str) -> str:
    return f"CASE WHEN orders > 0 AND {c} > 0 THEN {D(f'{c} / orders', 2)} ELSE CAST(0 AS DOUBLE) END"


define("benchmark_city", f"""
SELECT tenant_id, period, city_name, bench_vendors,
  CASE WHEN orders < 10 THEN orders * 4 WHEN orders < 20 THEN orders * 2 ELSE orders END AS benchmark_valid_orders,
  CAST({halved('declined')} AS DOUBLE) AS benchmark_cancellation_num,
  CASE WHEN declined > 6 THEN gmv_per_order * 3 WHEN declined > 3 THEN gmv * 0.5 ELSE gmv END AS benchmark_cancellations_gmv,
  CASE WHEN late / NULLIF(orders, 0) > 0.1 THEN {D(f"orders * ({hash_noise(8, 11, 1)} / 100)", 0)} ELSE late END AS benchmark_delay_num,
  CASE WHEN damaged > 2 THEN {D(hash_noise(1, 3, 2), 0)} ELSE damaged END AS benchmark_packaging_num,
  CASE WHEN missing_wrong > 3 THEN {D(hash_noise(2, 4, 3), 0)} ELSE missing_wrong END AS benchmark_missing_wrong_num,
  CASE WHEN offline > 3 THEN {D(hash_noise(1, 3, 4), 1)} ELSE offline END AS benchmark_offline_num,
  CAST({halved('overdue')} AS DOUBLE) AS benchmark_overdue_num,
  {bench_share('missing_wrong')} AS benchmark_missing_wrong_perc, {bench_share('damaged')} AS benchmark_packaging_perc,
  {bench_share('declined')} AS benchmark_cancellation_perc
FROM (SELECT tenant_id, period, city_name, MAX(place) AS bench_vendors,
    {', '.join(f"{D(f'SUM({c}) / CAST(MAX(place) AS DOUBLE)', n)} AS {a}" for c, n, a in (
        ('valid_orders', 0, 'orders'), ('declined_orders', 0, 'declined'), ('declined_gmv', 1, 'gmv'), ('vendor_late', 0, 'late'),
        ('overdue_orders', 0, 'overdue'), ('damaged_packaging', 0, 'damaged'), ('missing_wrong_items', 0, 'missing_wrong'),
        ('offline_hours', 1, 'offline')))},
    CASE WHEN SUM(declined_orders) > 0 THEN {D('SUM(declined_gmv) / CAST(SUM(declined_orders) AS DOUBLE)', 1)} ELSE 0 END AS gmv_per_order
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, period, city_name ORDER BY valid_orders DESC, vendor_id) AS place
    FROM (SELECT *, MAX(valid_orders) OVER (PARTITION BY tenant_id, period, city_name) AS max_orders FROM sendout_all)
    WHERE valid_orders > CASE WHEN max_orders > 250 THEN 75 ELSE max_orders * CAST(0.3 AS DOUBLE) END)
  GROUP BY 1, 2, 3)""")
BENCH_NUMBERS = """benchmark_valid_orders benchmark_cancellation_num benchmark_cancellations_gmv benchmark_delay_num
benchmark_packaging_num benchmark_missing_wrong_num benchmark_offline_num benchmark_overdue_num benchmark_missing_wrong_perc
benchmark_packaging_perc benchmark_cancellation_perc""".split()


@query("rpt_city_benchmark", sql(f"""
SELECT tenant_id, period, city_name, bench_vendors, {', '.join(f"{R(c, 4)} AS {c}" for c in BENCH_NUMBERS)} FROM benchmark_city"""))
def rpt_city_benchmark(t):
    return numbers(newsletter.city_benchmark(sendout(t)), 4)


define("issue_terms", f"""
SELECT tenant_id, vendor_id, vendor_late_percentage, {R('declined_orders / CAST(valid_orders AS DOUBLE) * 100')} AS canc,
  {R('vendor_late_percentage * 100')} AS delay, {R('missing_wrong_percentage * 100')} AS missing,
  {R('damaged_packaging_percentage * 100')} AS pack, {R('offline_hours / CAST(150 AS DOUBLE) * 100')} AS off,
  {R('(greatest(prep_time_avg, 15) - 15) / 300 * 100')} AS prep FROM sendout_all""")


def leads(name: str) -> str:
    others = " + ".join(x for x in ("canc", "delay", "missing", "pack", "off", "prep") if x != name)
    return f"{R(f'{name} * 5')} >= {R(others)}"


define("improvement_all", f"""
SELECT tenant_id, vendor_id, CASE WHEN {leads('canc')} AND canc > 0 THEN 1
  WHEN {leads('delay')} AND vendor_late_percentage > 0.03 THEN 2 WHEN {leads('missing')} AND missing > 0 THEN 3
  WHEN {leads('pack')} AND pack > 0 THEN 4 WHEN {leads('off')} AND off > 0 THEN 5
  WHEN prep > 0 AND pack + missing + canc + off > 0 THEN 6 ELSE 7 END AS improve_opportunity_num FROM issue_terms""")


@query("rpt_improvement_class", sql("SELECT * FROM improvement_all"))
def rpt_improvement_class(t):
    return newsletter.improve_class(sendout(t)).select("tenant_id", "vendor_id", "improve_opportunity_num")


@query("rpt_newsletter_final", sql(f"""
SELECT s.tenant_id, s.vendor_id, s.subscriber_key, s.valid_orders, s.declined_orders, s.vendor_late,
  CASE WHEN s.declined_orders < b.benchmark_cancellation_num AND s.vendor_late < b.benchmark_delay_num
    AND i.improve_opportunity_num IN (1, 2) THEN 7 ELSE i.improve_opportunity_num END AS improve_opportunity_num,
  {', '.join(f"{R(f'b.{c}', 4)} AS {c}" for c in BENCH_NUMBERS if c != 'benchmark_cancellations_gmv')},
  {R('CASE WHEN b.benchmark_cancellation_num < 1 THEN 0 ELSE b.benchmark_cancellations_gmv END', 4)} AS benchmark_cancellations_gmv
FROM sendout_all s JOIN improvement_all i ON i.tenant_id = s.tenant_id AND i.vendor_id = s.vendor_id
LEFT JOIN benchmark_city b ON b.tenant_id = s.tenant_id AND b.period = s.period AND b.city_name = s.city_name
WHERE s.email IS NOT NULL AND s.banner IS NOT NULL"""))
def rpt_newsletter_final(t):
    rows = sendout(t)
    sent = newsletter.with_benchmark(rows, newsletter.city_benchmark(rows)).where(C("email").isNotNull() & C("banner").isNotNull())
    return numbers(sent.select("tenant_id", "vendor_id", "subscriber_key", "valid_orders", "declined_orders", "vendor_late",
                               "improve_opportunity_num", *BENCH_NUMBERS), 4)


# -- delay attribution ------------------------------------------------------------------------

ZONES = [(0, 15, "Australia/Brisbane", "Australia/Sydney"), (1, 16, "America/Vancouver", "America/Toronto")]


COMPANY_WEEKS = {"First": 2}


@query("rpt_delay_attribution", sql(f"""
WITH resolved AS (
  SELECT p.tenant_id, p.order_id, delivered_ts, courier_late_min, vendor_late_min, prep_min, prep_buffer,
    COALESCE(CAST(a.gfv AS DOUBLE), CAST(b.gfv AS DOUBLE) * CAST(1.1 AS DOUBLE)) AS gfv, COALESCE(a.preorder, b.preorder) AS preorder,
    COALESCE(a.confirm_ts, b.confirm_ts) AS confirm_ts, COALESCE(a.city_id, b.city_id) AS city_id,
    COALESCE(vb.vendor_name, va.vendor_name) AS vendor_name, COALESCE(vb.vendor_code, va.vendor_code) AS vendor_code,
    isodow(delivered_ts) AS iso_day,
    hour(delivered_ts) + CASE WHEN minute(delivered_ts) <= 15 THEN 0 WHEN minute(delivered_ts) < 45 THEN 0.5 ELSE 1 END::DOUBLE AS slot,
    CASE WHEN p.tenant_id = 0 AND COALESCE(a.city_id, b.city_id) = 15 THEN timezone('Australia/Sydney', timezone('Australia/Brisbane', picked_ts))
      WHEN p.tenant_id = 1 AND COALESCE(a.city_id, b.city_id) = 16 THEN timezone('America/Toronto', timezone('America/Vancouver', picked_ts))
      ELSE picked_ts END AS picked
  FROM dispatch_orders p
  LEFT JOIN (SELECT * FROM placed_orders WHERE brand = 'A') a ON a.tenant_id = p.tenant_id AND a.order_id = p.order_id
  LEFT JOIN (SELECT * FROM placed_orders WHERE brand = 'B') b ON b.tenant_id = p.tenant_id AND b.order_id = p.order_id
  LEFT JOIN (SELECT * FROM vendors WHERE brand = 'A') va ON va.tenant_id = a.tenant_id AND va.vendor_id = a.vendor_id
  LEFT JOIN (SELECT * FROM vendors WHERE brand = 'B') vb ON vb.tenant_id = b.tenant_id AND vb.vendor_id = b.vendor_id
  WHERE dispatch_status = 'completed' AND lower(platform) = 'ours'),
days AS (SELECT CAST(unnest(range({day(DELAY_PERIOD.start)}, {day(DELAY_PERIOD.end)} + 1, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT days.day, strftime(days.day, '%G-%V') AS week, CAST(isodow(days.day) AS INTEGER) AS weekday, r.tenant_id, country_name, city_name, vendor_name, vendor_code,
  bucket AS hour_bucket, CAST(floor(slot) AS BIGINT) AS order_hour, order_id, {R('gfv', 4)} AS gfv,
  CASE WHEN courier_late_min < 0 THEN 0 ELSE courier_late_min END AS net_rider_delay,
  CASE WHEN vendor_late_min < 0 THEN 0 ELSE vendor_late_min END AS net_vendor_delay,
  CASE WHEN vendor_late_min >= 5 AND courier_late_min >= 5 THEN 1 ELSE 0 END AS delay_mix,
  CASE WHEN vendor_late_min < 5 AND courier_late_min >= 5 THEN 1 ELSE 0 END AS delay_rider,
  CASE WHEN vendor_late_min >= 5 AND courier_late_min < 5 THEN 1 ELSE 0 END AS delay_vendor,
  prep_min AS prep_time, prep_buffer, {R('CASE WHEN courier_late_min > 10 OR preorder = 1 THEN prep_min ELSE ROUND(CAST((epoch_us(picked) - epoch_us(confirm_ts)) / 60000000.0 AS DECIMAL(28,10)), 2) END', 4)} AS cooking_time,
  1 AS valid_orders, CASE WHEN vendor_late_min > 0 THEN 1 ELSE 0 END AS delay_flag
FROM days LEFT JOIN resolved r ON CAST(delivered_ts AS DATE) = days.day
LEFT JOIN prep_buckets b ON b.tenant_id = r.tenant_id AND b.weekday = iso_day AND b.half_hour = slot
LEFT JOIN countries co ON co.tenant_id = r.tenant_id LEFT JOIN cities ci ON ci.tenant_id = r.tenant_id AND ci.city_id = r.city_id
WHERE CASE WHEN company = 'First' THEN date_trunc('week', days.day) >= date_trunc('week', {day(EVENTS_AS_OF)}) - INTERVAL 2 WEEK
  ELSE date_trunc('week', days.day) >= date_trunc('week', {day(EVENTS_AS_OF)}) - INTERVAL 8 WEEK END"""))
def rpt_delay_attribution(t):
    return numbers(delay.delay_attribution(t, DELAY_PERIOD, EVENTS_AS_OF, COMPANY_WEEKS, zones=ZONES, rate=1.1), 4)


# -- configuration audit ----------------------------------------------------------------------

define("short_days_all", """
SELECT vendor_id, MAX(short) AS short_day FROM (SELECT vendor_id, weekday,
  CASE WHEN SUM(CASE WHEN stop_s = 0 THEN 86340 ELSE stop_s END - start_s) < 10800 THEN 1 ELSE 0 END AS short
  FROM schedules GROUP BY 1, 2) GROUP BY 1""")
define("inactive_city_all", """
SELECT v.tenant_id, v.vendor_id, c.city_name, CASE WHEN (city_active = 0 OR city_active IS NULL) AND vendor_deleted = 0
  AND vendor_active = 1 AND vendor_testing = 0 THEN 1 ELSE 0 END AS inactive_city
FROM vendors v JOIN countries co ON v.tenant_id = co.tenant_id
LEFT JOIN cities c ON v.tenant_id = c.tenant_id AND v.city_id = c.city_id WHERE managed""")
define("false_testing_all", f"""
SELECT o.tenant_id, o.vendor_id, COUNT(DISTINCT order_id) FILTER (WHERE valid_order = 1) AS valid_orders
FROM flagged_orders o JOIN vendors v ON o.vendor_id = v.vendor_id
WHERE vendor_testing = 1 AND order_day >= {day(AS_OF)} - 30 GROUP BY 1, 2
HAVING COUNT(DISTINCT order_id) FILTER (WHERE valid_order = 1) > 0""")
VAT_SQL = """CASE WHEN brand = 'A' AND v.tenant_id = 1 THEN CASE WHEN vat_included = 1 AND vendor_deleted = 0 THEN 1 ELSE 0 END
  WHEN brand = 'A' THEN CASE WHEN (vat_included IS NULL OR vat_included <> 1) AND vendor_deleted = 0 THEN 1 ELSE 0 END
  ELSE CASE WHEN vat_included IS NULL OR (vat_included <> 1 AND vendor_deleted = 0) THEN 1 ELSE 0 END END"""


@query("rpt_schedule_flag", sql("SELECT * FROM short_days_all LEFT JOIN home USING (vendor_id)"))
def rpt_schedule_flag(t):
    return audit.short_days(t)


@query("rpt_inactive_city", sql("SELECT * FROM inactive_city_all"))
def rpt_inactive_city(t):
    return audit.inactive_city(t)


@query("rpt_false_testing", sql("SELECT * FROM false_testing_all"))
def rpt_false_testing(t):
    return audit.false_testing(t, AS_OF)


@query("rpt_vat_flag", sql(f"SELECT v.tenant_id, v.vendor_id, {VAT_SQL} AS vat_issue FROM vendors v"))
def rpt_vat_flag(t):
    issue = audit.vat_flag(C("vat_included"), C("vendor_deleted"), C("tenant_id"), C("brand"), [1])
    return t.vendors().select("tenant_id", "vendor_id", issue.alias("vat_issue"))


def off(c: str) -> str:
    return f"CASE WHEN ({c} IS NULL OR {c} <> 1) AND vendor_deleted = 0 THEN 1 ELSE 0 END"


@query("rpt_backend_audit", sql(f"""
SELECT * FROM (SELECT brand, v.tenant_id, country_name, i.city_name, v.vendor_id, vendor_code, vendor_name,
  CASE WHEN vendor_active = 1 AND vendor_deleted = 0 THEN short_day ELSE 0 END AS weird_opening_hours,
  CASE WHEN f.valid_orders > 0 AND vendor_deleted = 0 THEN 1 ELSE 0 END AS false_testing,
  CASE WHEN regexp_matches(vendor_name, '0000[0-4]', 'i') AND vendor_testing <> 1 AND vendor_deleted = 0 THEN 1 ELSE 0 END AS testing_not_flagged,
  {off('automatic_calls_enabled')} AS autocall_not_enabled, {off('accept_delivery')} AS no_delivery, {VAT_SQL} AS vat_issue,
  {off('accept_discount')} AS no_discount, {off('accept_voucher')} AS no_voucher,
  CASE WHEN (automatic_calls_delay IS NULL OR automatic_calls_delay NOT IN (1, 2)) AND vendor_deleted = 0 THEN 1 ELSE 0 END AS calls_delay_error,
  CASE WHEN (phone = '' OR phone IS NULL OR length(trim(phone)) < 8) AND vendor_deleted = 0 THEN 1 ELSE 0 END AS improper_phone,
  CASE WHEN active_menus < 1 AND vendor_deleted = 0 THEN 1 ELSE 0 END AS no_active_menu, {off('online_payment')} AS no_online_payment,
  i.inactive_city, CASE WHEN account_status NOT IN ('Active', 'Qualified') AND vendor_deleted = 0 THEN 1 ELSE 0 END AS crm_inactive
FROM vendors v LEFT JOIN false_testing_all f ON v.vendor_id = f.vendor_id LEFT JOIN short_days_all s ON v.vendor_id = s.vendor_id
LEFT JOIN countries c ON v.tenant_id = c.tenant_id LEFT JOIN inactive_city_all i ON i.vendor_id = v.vendor_id WHERE vendor_active = 1)
WHERE weird_opening_hours + false_testing + testing_not_flagged + autocall_not_enabled + no_delivery + vat_issue + no_discount
  + no_voucher + calls_delay_error + improper_phone + no_active_menu + no_online_payment + inactive_city + crm_inactive > 0"""))
def rpt_backend_audit(t):
    return audit.backend_audit(t, AS_OF, [1], test_pattern="0000[0-4]")


# -- stock ------------------------------------------------------------------------------------

LEAD_DAYS = {"AFRICA": 11, "AMERICA": 10, "ASIA": 12, "EUROPE": 9}
define("stock_newest", f"""
SELECT s.vendor_id, product_date, quantity, auto_supply, check_stock, check_date,
  CASE WHEN consumption = 'Above Average (1.5 Bags per Order)' THEN CAST(1.6 AS DOUBLE)
    WHEN consumption IN ('Normal (1 - 1.5 per Order)', 'Average (1.1 Bags per Order)') THEN CAST(1.1 AS DOUBLE)
    WHEN regexp_matches(consumption, 'low', 'i') THEN CAST(0.6 AS DOUBLE) ELSE CAST(1.1 AS DOUBLE) END AS bags_per_order,
  CAST(product_date - DATE '2001-07-15' AS INTEGER) AS days, CAST(check_date - DATE '2001-07-15' AS INTEGER) AS days_since_check,
  CAST(abs(product_date - DATE '2001-07-15') AS INTEGER) AS days_numeric
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY product_date DESC, consumption DESC) AS r
  FROM (SELECT vendor_id, product_date, consumption, CAST(SUM(quantity) AS BIGINT) AS quantity FROM stock GROUP BY 1, 2, 3)) s
JOIN supply_terms x ON x.vendor_id = s.vendor_id JOIN contracts c ON c.vendor_id = s.vendor_id
WHERE r = 1 AND auto_supply = 1 AND contract_status IN ('Activated', 'Amended')""")
define("stock_usage", f"""
SELECT *, orders_l4w / CAST(30 AS DOUBLE) AS order_per_day, quantity - orders * bags_per_order AS remaining,
  check_stock - orders_check * bags_per_order AS remaining_check FROM (
SELECT o.tenant_id, o.vendor_id, CASE WHEN product_date > {day(AS_OF)} THEN {day(AS_OF)} - 2 ELSE product_date END AS product_date,
  quantity, bags_per_order, auto_supply, check_stock, check_date, days, days_numeric,
  COUNT(*) FILTER (WHERE order_day >= {day(AS_OF)} + days) AS orders,
  COUNT(*) FILTER (WHERE order_day >= {day(AS_OF)} + days_since_check) AS orders_check,
  COUNT(*) FILTER (WHERE order_day >= {day(AS_OF)} - 28) AS orders_l4w
FROM flagged_orders o LEFT JOIN stock_newest p ON p.vendor_id = o.vendor_id WHERE valid_order = 1
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)""")
define("stock_planned", f"""
SELECT u.*, vendor_code, city_name, country_name, activation_date, address_line1, postcode,
  CASE WHEN vendor_code = 'v4' AND city_name = 'NATION_7' THEN 100 WHEN vendor_code = 'v4' AND v.tenant_id = 1 THEN 500
    WHEN vendor_code = 'v4' THEN 250 WHEN vendor_code = 'v6' AND v.tenant_id IN (0, 2) THEN 125 WHEN orders_l4w < 5 THEN 250 WHEN orders_l4w < 9 THEN 500 ELSE 750 END AS order_tier,
  CASE WHEN orders_l4w < 5 THEN 1 WHEN orders_l4w < 9 THEN 2 ELSE 3 END AS tier_step,
  CASE {' '.join(f"WHEN regexp_matches(country_name, '{k}', 'i') THEN order_per_day * bags_per_order * {n}" for k, n in LEAD_DAYS.items())} END AS estimation,
  CASE WHEN activation_date BETWEEN {day(AS_OF)} - 7 AND {day(AS_OF)} THEN 1 ELSE 0 END AS new_vendor
FROM stock_usage u JOIN vendors v ON v.vendor_id = u.vendor_id JOIN countries c ON v.tenant_id = c.tenant_id
JOIN cities ci ON ci.city_id = v.city_id""")


# NULL fits any tenant or city
TIERS = "(NULL, NULL, 'v4', 250), (1L, NULL, 'v4', 500), (NULL, 'NATION_7', 'v4', 100), (0L, NULL, 'v6', 125), (2L, NULL, 'v6', 125)"
STREETS = "(NULL, NULL, 'v5', 'Side door 5'), (3L, NULL, 'v5', 'Back door 5'), (2L, 'NATION_9', 'v7', 'Gate 7')"


def exceptions(t, rows: str, value: str):
    return inline(t.spark, f"tenant_id, city_name, vendor_code, {value}", rows)


def planned(t):
    places = t.vendors().join(t.countries().select("tenant_id", "country_name"), "tenant_id").join(
        t.cities().select("tenant_id", "city_id", "city_name"), ["tenant_id", "city_id"])
    vendors = places.select("tenant_id", "vendor_id", "vendor_code", "city_name", "country_name", "activation_date",
                            "address_line1", "postcode")
    return stock.stock_plan(stock.stock_use(t, AS_OF), vendors, AS_OF, LEAD_DAYS, steps=(5, 9), fixed_tier=exceptions(t, TIERS, "order_tier"))


@query("rpt_stock_latest", sql("SELECT * FROM stock_newest JOIN home USING (vendor_id)"))
def rpt_stock_latest(t):
    return stock.stock_latest(t, AS_OF)


USE_COLUMNS = """tenant_id, vendor_id, product_date, quantity, auto_supply, check_stock, check_date, days, days_numeric, orders,
  orders_check, orders_l4w"""
USE_NUMBERS = ["bags_per_order", "order_per_day", "remaining", "remaining_check"]


@query("rpt_stock_consumption", sql(f"SELECT {USE_COLUMNS}, {', '.join(f'{R(c)} AS {c}' for c in USE_NUMBERS)} FROM stock_usage"))
def rpt_stock_consumption(t):
    return numbers(stock.stock_use(t, AS_OF))


@query("rpt_stock_order_tier", sql(f"""
SELECT {USE_COLUMNS}, {', '.join(f'{R(c)} AS {c}' for c in [*USE_NUMBERS, 'estimation'])}, vendor_code, city_name, country_name,
  activation_date, address_line1, postcode, order_tier, tier_step, new_vendor FROM stock_planned"""))
def rpt_stock_order_tier(t):
    return numbers(planned(t))


define("stock_base", f"""
SELECT p.*, billing_street, billing_postcode, u.vendor_id IS NULL AS free,
  CASE WHEN p.check_date >= product_date AND product_date < {day(AS_OF)} - 7 THEN remaining_check ELSE remaining END AS remaining_used,
  CASE WHEN p.check_stock IS NULL THEN remaining ELSE p.check_stock END AS new_stock,
  CASE WHEN p.check_date >= product_date THEN p.check_date ELSE product_date END AS last_date,
  CASE WHEN p.check_date >= product_date THEN p.check_stock ELSE quantity END AS quantity_used,
  CASE WHEN p.check_date > product_date THEN orders_check ELSE orders END AS orders_interval,
  CASE WHEN order_per_day >= 1 AND (product_date < {day(AS_OF)} - 7 OR product_date IS NULL)
    AND (p.check_date < {day(AS_OF)} - 7 OR p.check_date IS NULL) AND bags_per_order > 0.9 THEN 1 ELSE 0 END AS regular
FROM stock_planned p LEFT JOIN supply_terms x ON x.vendor_id = p.vendor_id
LEFT JOIN (SELECT DISTINCT vendor_id FROM opportunities WHERE record_type = '{MATERIAL}' AND stage = 'New') u ON u.vendor_id = p.vendor_id""")
define("stock_decided", """
SELECT tenant_id, vendor_id, vendor_code, country_name, city_name, product_date, last_date, remaining_used, new_stock, quantity,
  quantity_used, days, orders, orders_interval, order_per_day, orders_l4w, order_tier, tier_step, estimation, regular, check_date,
  check_stock, COALESCE(door, address_line1, billing_street) AS address, COALESCE(postcode, billing_postcode) AS postcode,
  shipping_city, shipping_phone, COALESCE(door, shipping_street) AS shipping_street, shipping_postcode, """ + ", ".join(
    f"CASE WHEN times_{d} IS NULL THEN '-' ELSE times_{d} END AS times_{d}" for d in "monday tuesday wednesday thursday friday saturday".split()) + """,
  CASE WHEN tenant_id = 3 AND order_per_day > 0.2 THEN 'included'
    WHEN FALSE THEN 'included' ELSE CASE
    WHEN estimation > remaining_used OR (new_vendor = 1 AND order_per_day >= 1 AND quantity_used < 60 AND auto_supply = 1
      AND bags_per_order IS NOT NULL AND tenant_id <> 3) THEN 'included'
    WHEN order_per_day > 1 AND quantity_used IS NULL AND auto_supply = 1 THEN 'included'
    WHEN auto_supply = 1 AND remaining_used <= 0 AND orders_l4w > 0 AND free THEN 'included'
    WHEN city_name = 'NATION_7' AND auto_supply = 1 AND remaining_used <= 0 AND free THEN 'included' ELSE 'n.a.' END END AS status,
  CASE WHEN tenant_id = 2 AND vendor_code <> 'v12' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sales_price,
  CASE WHEN tenant_id = 2 AND vendor_code <> 'v12' THEN order_tier ELSE 0 END AS billing_quantity
FROM (SELECT *, CASE WHEN vendor_code = 'v5' AND tenant_id = 3 THEN 'Back door 5' WHEN vendor_code = 'v5' THEN 'Side door 5'
  WHEN vendor_code = 'v7' AND tenant_id = 2 AND city_name = 'NATION_9' THEN 'Gate 7' END AS door FROM stock_base)
LEFT JOIN shipping_addresses USING (tenant_id, vendor_code)""")


def decided(t):
    return stock.stock_decision(
        t, planned(t), AS_OF, MATERIAL, manual_tenants=[3], always_cities=["NATION_7"], billed_tenants=[2],
        unbilled=["v12"], streets=exceptions(t, STREETS, "street"), manual_rate=0.2)


ROUNDED = ["remaining_used", "new_stock", "order_per_day", "estimation"]
DECIDED_SQL = "SELECT * REPLACE (" + ", ".join(f"{R(c)} AS {c}" for c in ROUNDED) + ") FROM stock_decided"


@query("rpt_stock_decision", sql(DECIDED_SQL))
def rpt_stock_decision(t):
    return numbers(decided(t))


@query("rpt_stock_feedback", sql(f"""
SELECT d.tenant_id, d.vendor_id, {R('remaining_used')} AS remaining_used, d.check_stock AS known_stock, f.reported_stock,
  d.check_date AS known_date, f.report_date AS reported_date, {R('new_stock')} AS new_stock, last_date, quantity, quantity_used, orders,
  {R('order_per_day')} AS order_per_day, {R('estimation')} AS estimation, status, {R('remaining_used - f.reported_stock')} AS difference
FROM stock_decided d LEFT JOIN (
  SELECT * FROM stock_reports QUALIFY row_number() OVER (PARTITION BY tenant_id, vendor_id ORDER BY report_date DESC, report_id DESC) = 1) f
ON f.tenant_id = d.tenant_id AND f.vendor_id = d.vendor_id"""))
def rpt_stock_feedback(t):
    return numbers(stock.stock_feedback(decided(t), t.stock_reports()))


# -- deals ------------------------------------------------------------------------------------

FORMER, DEAL = periods.fixed(date(2001, 5, 1), date(2001, 5, 31)), MONTH


@query("rpt_deal_uplift", sql(f"""
WITH cohort AS (SELECT * FROM vendors WHERE account_status = 'Active' AND vendor_id IN (SELECT vendor_id FROM opportunities
    WHERE record_type = '{MATERIAL}' AND stage = 'Closed Won' AND {between('created_date', FORMER)})),
sums AS (SELECT vendor_id,
    COUNT(DISTINCT order_id) FILTER (WHERE {between('order_day', DEAL)}) AS orders_deal_month,
    COUNT(DISTINCT order_id) FILTER (WHERE order_day BETWEEN {day(FORMER.start)} AND {day(DEAL.start)}) AS orders_former_month,
    COUNT(DISTINCT customer_id) FILTER (WHERE {between('order_day', DEAL)}) AS customers_deal_month,
    COUNT(DISTINCT customer_id) FILTER (WHERE order_day BETWEEN {day(FORMER.start)} AND {day(DEAL.start)}) AS customers_former_month,
    CAST(SUM(gfv) FILTER (WHERE {between('order_day', DEAL)}) AS DOUBLE) AS sales_now,
    CAST(SUM(gfv) FILTER (WHERE order_day BETWEEN {day(FORMER.start)} AND {day(DEAL.start)}) AS DOUBLE) AS sales_before
  FROM flagged_orders WHERE valid_order = 1 AND order_day BETWEEN {day(FORMER.start)} AND {day(DEAL.end)} GROUP BY 1),
joined AS (SELECT c.*, s.* EXCLUDE (vendor_id), b.banner, e.email, co.country_name, ci.city_name,
    orders_deal_month / NULLIF(CAST(orders_former_month AS DOUBLE), 0) - 1 AS growth
  FROM cohort c LEFT JOIN sums s ON s.vendor_id = c.vendor_id LEFT JOIN banner_all b ON b.vendor_id = c.vendor_id
  LEFT JOIN contact_first e ON e.vendor_code = c.vendor_code LEFT JOIN countries co ON co.tenant_id = c.tenant_id
  LEFT JOIN cities ci ON ci.city_id = c.city_id)
SELECT tenant_id, vendor_id, vendor_code, vendor_name, country_name, city_name, email, '{DEAL.label}' AS deals_month,
  CASE WHEN vendor_id IN (SELECT vendor_id FROM opportunities WHERE stage = 'Closed Won' AND strftime(created_date, '%Y-%m') = '2001-04')
    THEN 'True' ELSE 'False' END AS deal_former_month,
  activation_date, orders_deal_month, orders_former_month, {D('sales_now', 0)} AS sales_deal_month, {D('sales_before', 0)} AS sales_former_month,
  customers_deal_month, customers_former_month, {R('growth')} AS growth,
  CAST(round_even(sales_now / orders_deal_month, 0) AS INTEGER) AS afv_deal_month, banner,
  CASE WHEN growth > 2 THEN CAST(CAST(round_even(growth, 0) AS INTEGER) AS VARCHAR) || ' times'
    ELSE CAST(CAST(round_even(CAST(CAST(growth AS DECIMAL(20,2)) AS DOUBLE) * 100, 0) AS BIGINT) AS VARCHAR) || ' %' END AS growth_orders,
  CASE WHEN growth >= 0.10 THEN 'True' ELSE 'False' END AS display_growth FROM joined"""))
def rpt_deal_uplift(t):
    april = periods.fixed(date(2001, 4, 1), date(2001, 4, 30))
    confirmed = t.opportunities().where(
        (C("stage") == "Closed Won") & C("created_date").between(F.lit(april.start), F.lit(april.end)))
    return numbers(deals.deal_uplift(t, FORMER, DEAL, MATERIAL, confirmed))


# -- ramp-up ----------------------------------------------------------------------------------

@query("rpt_vendor_ramp", sql(f"""
WITH started AS (SELECT vendor_id, order_day AS start_day FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY order_ts, order_id) AS r
    FROM vendor_orders) WHERE r = 25),
op AS (SELECT o.vendor_id,
    {', '.join(f"COUNT(DISTINCT order_id) FILTER (WHERE order_day BETWEEN activation_date AND activation_date + {n}) AS orders_first_{k}" for k, n in ramp.SPANS.items())},
    COUNT(DISTINCT order_id) FILTER (WHERE order_day BETWEEN start_day AND start_day + 180) AS orders_after_start
  FROM flagged_orders o JOIN vendors v ON v.vendor_id = o.vendor_id LEFT JOIN started s ON s.vendor_id = o.vendor_id
  WHERE valid_order = 1 GROUP BY 1)
SELECT v.tenant_id, v.vendor_id, country_name, vendor_code, vendor_name, activation_date, op.* EXCLUDE (vendor_id),
  CAST(({day(AS_OF)} - activation_date) // 12 AS INTEGER) AS months_live,
  CASE WHEN orders_first_6_month < 40 AND {day(AS_OF)} - activation_date > 180 THEN 1 END AS flag_6_month,
  CASE WHEN orders_first_year < 80 AND {day(AS_OF)} - activation_date > 365 THEN 1 END AS flag_year,
  CASE WHEN orders_after_start < 35 AND {day(AS_OF)} - activation_date > 180 THEN 1 END AS flag_after_start
FROM vendors v LEFT JOIN countries c ON c.tenant_id = v.tenant_id LEFT JOIN op ON op.vendor_id = v.vendor_id WHERE vendor_active = 1"""))
def rpt_vendor_ramp(t):
    return ramp.ramp(t, AS_OF, low=(40, 80, 35))
