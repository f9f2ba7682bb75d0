"""Filters, projections and scalar functions, each over a whole table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from partner_analytics import functions as X
from partner_analytics.catalog.core import MONTH, between, day, numbers
from partner_analytics.catalog.oracle import R, define, sql
from partner_analytics.catalog.registry import query
from partner_analytics.operators import filters
from partner_analytics.sources.tables import AS_OF, EVENTS_AS_OF

C = F.col


# -- filters and predicates -------------------------------------------------------------------

@query("flt_between_scalar", sql(f"SELECT o_orderkey, o_custkey FROM orders WHERE {between('CAST(o_orderdate AS DATE)', MONTH)}"))
def flt_between_scalar(t):
    return filters.where_period(t.raw("orders"), "o_orderdate", MONTH).select("o_orderkey", "o_custkey")


@query("flt_in_list", sql("""
SELECT vendor_id, CASE WHEN chain_id IN (1, 4, 9, 16) THEN 'listed' ELSE 'other' END AS side FROM vendors
WHERE chain_id IN (1, 4, 9, 16) OR chain_id NOT IN (1, 4, 9, 16, 2, 3)"""))
def flt_in_list(t):
    chains = [1, 4, 9, 16]
    listed = filters.where_in(t.vendors(), "chain_id", chains).select("vendor_id", F.lit("listed").alias("side"))
    other = filters.where_in(t.vendors(), "chain_id", [*chains, 2, 3], keep=False)
    return listed.unionByName(other.select("vendor_id", F.lit("other").alias("side")))


@query("flt_case_predicate", sql("""
SELECT opportunity_id, record_type, created_date FROM opportunities WHERE CASE
  WHEN value > 300000 AND record_type IN ('Partner - Commission Renegotiation', 'Partner - Gain Exclusivity')
    THEN created_date >= DATE '2001-01-16'
  WHEN record_type IN ('Partner - Commission Renegotiation', 'Partner - Gain Exclusivity') THEN created_date >= DATE '2001-04-16'
  WHEN record_type IN ('Partner - FB Advertiser Rights', 'Partner - OM Backlink') THEN created_date >= DATE '2001-05-16'
  WHEN record_type = 'Partner - In-Restaurant Material' AND stage <> 'New' THEN created_date >= DATE '2001-06-16' END"""))
def flt_case_predicate(t):
    kind, made = C("record_type"), C("created_date")
    major = kind.isin("Partner - Commission Renegotiation", "Partner - Gain Exclusivity")

    def since(months):
        return made >= X.shift(X.as_of(AS_OF), -months, "month")

    rules = [
        ((C("value") > 300000) & major, since(6)), (major, since(3)),
        (kind.isin("Partner - FB Advertiser Rights", "Partner - OM Backlink"), since(2)),
        ((kind == "Partner - In-Restaurant Material") & (C("stage") != "New"), since(1)),
    ]
    return filters.where_case(t.opportunities(), rules).select("opportunity_id", "record_type", "created_date")


@query("flt_null_or_not", sql("""
SELECT vendor_id, accept_voucher IS NULL OR accept_voucher <> 1 AS no_voucher,
  accept_discount IS NULL OR accept_discount <> 1 AS no_discount,
  online_payment IS NULL OR online_payment <> 1 AS no_payment FROM vendors"""))
def flt_null_or_not(t):
    names = {"accept_voucher": "no_voucher", "accept_discount": "no_discount", "online_payment": "no_payment"}
    return t.vendors().select("vendor_id", *[X.not_enabled(C(c)).alias(n) for c, n in names.items()])


@query("flt_regex", sql("""
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'R.NG', 'i') AND NOT regexp_matches(p_name, 'Red')
  AND regexp_matches(p_name, '^[a-m]')"""))
def flt_regex(t):
    name = C("p_name")
    return t.raw("part").where(
        X.rx(name, "R.NG") & ~X.rx(name, "Red", False) & X.rx(name, "^[a-m]", False)).select("p_partkey", "p_name")


@query("flt_like_any", sql("""
SELECT p_partkey, CASE WHEN p_name LIKE 'red %' OR p_name LIKE '%bolt' OR p_name LIKE 'small ring' OR p_name LIKE 'blue &'
  THEN 1 ELSE p_size % 2 END AS flag FROM part"""))
def flt_like_any(t):
    hit = X.like_any(C("p_name"), ["red %", "%bolt", "small ring", "blue &"])
    return t.raw("part").select("p_partkey", F.when(hit, 1).otherwise(C("p_size") % 2).alias("flag"))


@query("flt_column_compare", sql("""
SELECT vendor_id, report_date, closed_hours, open_hours FROM offline WHERE closed_hours < open_hours AND closed_hours > 0"""))
def flt_column_compare(t):
    return filters.where_lt(t.offline(), "closed_hours", "open_hours").where(C("closed_hours") > 0).drop("declined_hours", "tenant_id")


@query("prj_safe_ratio", sql(f"""
SELECT vendor_id, report_date, {R('cr3_end / NULLIF(CAST(cr3_start AS DOUBLE), 0)')} AS rate FROM funnel"""))
def prj_safe_ratio(t):
    return numbers(t.funnel().select("vendor_id", "report_date", X.ratio(C("cr3_end"), C("cr3_start")).alias("rate")))


@query("prj_case_map", sql("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Commercial' WHEN '2-HIGH' THEN 'Commercial'
  WHEN '3-MEDIUM' THEN 'Marketing' ELSE 'Other' END AS area FROM orders"""))
def prj_case_map(t):
    labels = {"1-URGENT": "Commercial", "2-HIGH": "Commercial", "3-MEDIUM": "Marketing"}
    return t.raw("orders").select("o_orderkey", X.case_map(C("o_orderpriority"), labels, "Other").alias("area"))


@query("prj_null_fallback", sql("""
SELECT vendor_id, COALESCE(backend_email, phone, '-') AS reach, COALESCE(chain_id, -1) AS chain FROM vendors"""))
def prj_null_fallback(t):
    return t.vendors().select(
        "vendor_id", F.coalesce("backend_email", "phone", F.lit("-")).alias("reach"),
        F.coalesce("chain_id", F.lit(-1)).alias("chain"))


@query("prj_clamp_zero", sql("""
SELECT order_id, vendor_id, CASE WHEN vendor_late_min < 0 THEN 0 ELSE vendor_late_min END AS net_vendor,
  CASE WHEN courier_late_min < 0 THEN 0 ELSE courier_late_min END AS net_courier FROM vendor_orders"""))
def prj_clamp_zero(t):
    return t.vendor_orders().select(
        "order_id", "vendor_id", X.clamp0(C("vendor_late_min")).alias("net_vendor"),
        X.clamp0(C("courier_late_min")).alias("net_courier"))


# -- text -------------------------------------------------------------------------------------

@query("fn_concat_null", sql("""
SELECT vendor_id, vendor_code || '_' || CAST(chain_id AS VARCHAR) AS strict_key,
  concat(vendor_code, '_', chain_id) AS loose_key FROM vendors"""))
def fn_concat_null(t):
    parts = (C("vendor_code"), F.lit("_"), C("chain_id"))
    return t.vendors().select(
        "vendor_id", X.concat_strict(*parts).alias("strict_key"), X.concat_skip(*parts).alias("loose_key"))


@query("fn_split_part", sql("""
SELECT opportunity_id, split_part(record_type, ' - ', 2) AS kind, upper(split_part(record_type, ' ', 9)) AS ninth
FROM opportunities"""))
def fn_split_part(t):
    return t.opportunities().select(
        "opportunity_id", X.part(C("record_type"), " - ", 2).alias("kind"),
        F.upper(X.part(C("record_type"), " ", 9)).alias("ninth"))


@query("fn_case_trim_length", sql("""
SELECT vendor_id, upper(vendor_name) AS up, lower(vendor_name) AS low, length(trim(phone)) AS n,
  phone IS NULL OR phone = '' OR length(trim(phone)) < 8 AS bad FROM vendors"""))
def fn_case_trim_length(t):
    return t.vendors().select(
        "vendor_id", F.upper("vendor_name").alias("up"), F.lower("vendor_name").alias("low"),
        F.length(F.trim("phone")).alias("n"), X.bad_phone(C("phone"), 8).alias("bad"))


@query("fn_substring_zero", sql("SELECT c_custkey, left(c_name, 15) AS short_id FROM customer"))
def fn_substring_zero(t):
    return t.raw("customer").select("c_custkey", X.id15(C("c_name")).alias("short_id"))


@query("fn_string_to_array", sql("""
SELECT account_id, length(competitors) - length(replace(competitors, ';', '')) + 1 AS n,
  string_split(competitors, ';')[1] AS first_one FROM accounts"""))
def fn_string_to_array(t):
    names = X.to_array(C("competitors"), ";")
    return t.accounts().select("account_id", F.size(names).cast("bigint").alias("n"), names[0].alias("first_one"))


@query("fn_array_any", sql("""
SELECT account_id, list_contains(string_split(competitors, ';'), 'red') OR list_contains(string_split(competitors, ';'), 'bolt') AS hit
FROM accounts"""))
def fn_array_any(t):
    return t.accounts().select("account_id", X.any_eq(X.to_array(C("competitors"), ";"), ["red", "bolt"]).alias("hit"))


@query("fn_array_overlap", sql("""
SELECT order_id, vendor_id, list_has_any(code_array, [51, 56, 591]) AS acted FROM vendor_orders"""))
def fn_array_overlap(t):
    return t.vendor_orders().select(
        "order_id", "vendor_id", X.overlaps(C("code_array"), [51, 56, 591]).alias("acted"))


@query("fn_array_to_string", sql("""
SELECT order_id, vendor_id, array_to_string(code_array, '|') AS codes FROM vendor_orders"""))
def fn_array_to_string(t):
    return t.vendor_orders().select(
        "order_id", "vendor_id", X.join_text(C("code_array").cast("array<string>"), "|").alias("codes"))


@query("fn_text_percent", sql("""
SELECT vendor_id, CAST(CAST(round_even(commission_pct * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS pct FROM contracts"""))
def fn_text_percent(t):
    return t.contracts().select("vendor_id", X.pct_text(C("commission_pct")).alias("pct"))


@query("fn_growth_text", sql("""
SELECT vendor_id, growth_class, CASE WHEN g > 2 THEN CAST(CAST(round_even(g, 0) AS INTEGER) AS VARCHAR) || ' times'
  ELSE CAST(CAST(round_even(CAST(CAST(g AS DECIMAL(20,2)) AS DOUBLE) * 100, 0) AS BIGINT) AS VARCHAR) || ' %' END AS growth
FROM (SELECT vendor_id, report_date AS growth_class, open_hours / NULLIF(CAST(closed_hours AS DOUBLE), 0) - 1 AS g FROM offline)"""))
def fn_growth_text(t):
    growth = X.ratio(C("open_hours"), C("closed_hours")) - 1
    return t.offline().select("vendor_id", C("report_date").alias("growth_class"), X.growth_text(growth).alias("growth"))


# -- dates ------------------------------------------------------------------------------------

@query("fn_date_trunc", sql("""
SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events"""))
def fn_date_trunc(t):
    return t.raw("events").select(
        "event_id", X.period_start(C("ts"), "month").alias("month_start"), X.period_start(C("ts"), "week").alias("week_start"))


@query("fn_date_arith", sql(f"""
SELECT vendor_id, activation_date + 30 AS plus_month_days, CAST(activation_date - INTERVAL 1 MONTH AS DATE) AS month_before,
  CAST(activation_date + INTERVAL 2 WEEK AS DATE) AS two_weeks, CAST({day(AS_OF)} - activation_date AS INTEGER) AS age FROM vendors"""))
def fn_date_arith(t):
    start = C("activation_date")
    return t.vendors().select(
        "vendor_id", X.shift(start, 30, "day").alias("plus_month_days"), X.shift(start, -1, "month").alias("month_before"),
        X.shift(start, 2, "week").alias("two_weeks"), F.datediff(X.as_of(AS_OF), start).alias("age"))


@query("fn_days_between_ts", sql("""
SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events"""))
def fn_days_between_ts(t):
    return t.raw("events").select(
        "event_id", X.whole_days(F.lit(EVENTS_AS_OF).cast("timestamp_ntz"), C("ts")).alias("days"))


@query("fn_epoch_minutes", sql(f"""
SELECT event_id, {R("(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 60000000.0", 4)} AS minutes FROM events"""))
def fn_epoch_minutes(t):
    midnight = F.to_date("ts").cast("timestamp_ntz")
    return numbers(t.raw("events").select("event_id", X.minutes_between(C("ts"), midnight).alias("minutes")), 4)


@query("fn_half_hour", sql("""
SELECT event_id, hour(ts) + CASE WHEN minute(ts) <= 15 THEN 0 WHEN minute(ts) < 45 THEN 0.5 ELSE 1 END::DOUBLE AS slot,
  CAST(floor(hour(ts) + CASE WHEN minute(ts) <= 15 THEN 0 WHEN minute(ts) < 45 THEN 0.5 ELSE 1 END::DOUBLE) AS BIGINT) AS slot_hour FROM events"""))
def fn_half_hour(t):
    slot = X.half_hour(C("ts"))
    return t.raw("events").select("event_id", slot.alias("slot"), F.floor(slot).alias("slot_hour"))


@query("fn_iso_week_key", sql("SELECT o_orderkey, strftime(o_orderdate, '%G-%V') AS week_key FROM orders"))
def fn_iso_week_key(t):
    return t.raw("orders").select("o_orderkey", X.iso_week_key(C("o_orderdate")).alias("week_key"))


@query("fn_iso_month_key", sql("SELECT o_orderkey, strftime(o_orderdate, '%G-%m') AS month_key FROM orders"))
def fn_iso_month_key(t):
    return t.raw("orders").select("o_orderkey", X.iso_month_key(C("o_orderdate")).alias("month_key"))


@query("fn_mixed_week_keys", sql("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, strftime(o_orderdate, '%Y-%V') AS year_week,
  strftime(o_orderdate, '%G-%m') AS iso_month, strftime(o_orderdate, '%G-%V') AS iso_week,
  strftime(o_orderdate, '%G') || '-' || lpad(CAST((dayofyear(o_orderdate) + 6) // 7 AS VARCHAR), 2, '0') AS iso_sevenday FROM orders"""))
def fn_mixed_week_keys(t):
    styles = ["year-month", "year-week", "iso-month", "iso-week", "iso-sevenday"]
    return t.raw("orders").select(
        "o_orderkey", *[X.week_key(C("o_orderdate"), s).alias(s.replace("-", "_")) for s in styles])


@query("fn_time_wrap", sql("""
SELECT vendor_id, weekday, start_s, CASE WHEN stop_s = 0 THEN 86340 ELSE stop_s END AS stop_s FROM schedules"""))
def fn_time_wrap(t):
    return t.schedules().drop("tenant_id").withColumn("stop_s", X.close_second(C("stop_s")))


@query("fn_time_zone", sql("""
SELECT delivery_id, CASE WHEN vendor_id % 5 = 0 THEN timezone('Australia/Sydney', timezone('Australia/Brisbane', ts))
  WHEN vendor_id % 5 = 1 THEN timezone('America/Toronto', timezone('America/Vancouver', ts)) ELSE ts END AS local_ts
FROM deliveries"""))
def fn_time_zone(t):
    ts, who = C("ts"), C("vendor_id") % 5
    local = (F.when(who == 0, X.shift_zone(ts, "Australia/Brisbane", "Australia/Sydney"))
             .when(who == 1, X.shift_zone(ts, "America/Vancouver", "America/Toronto")).otherwise(ts))
    return t.deliveries().select("delivery_id", local.alias("local_ts"))


@query("fn_as_of", sql(f"""
SELECT vendor_id, {day(AS_OF)} AS today, activation_date + 1825 <= {day(AS_OF)} AS older_than_five_years FROM vendors"""))
def fn_as_of(t):
    today = X.as_of(AS_OF)
    return t.vendors().select(
        "vendor_id", today.alias("today"), (X.shift(C("activation_date"), 1825, "day") <= today).alias("older_than_five_years"))


# -- numbers ----------------------------------------------------------------------------------

@query("fn_round_trunc", sql(f"""
SELECT event_id, CAST(ROUND(CAST(value AS DECIMAL(28,10)), 1) AS DOUBLE) AS rounded,
  CAST(trunc(CAST(value AS DECIMAL(28,10)) * 10) / 10 AS DOUBLE) AS cut, CAST(round_even(value, 0) AS INTEGER) AS whole FROM events"""))
def fn_round_trunc(t):
    v = C("value")
    return t.raw("events").select(
        "event_id", X.round_half_away(v, 1).cast("double").alias("rounded"),
        X.trunc_n(v, 1).cast("double").alias("cut"), X.nearest_int(v).alias("whole"))


@query("fn_math", sql(f"""
SELECT s_suppkey, abs(s_acctbal) AS size, greatest(s_acctbal, 15.0) AS at_least, {R('power(s_suppkey, 2)')} AS squared,
  CAST(trunc(s_acctbal) AS BIGINT) // 12 AS twelfth FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, abs(s_acctbal), greatest(s_acctbal, 15.0), {R('power(s_suppkey, 2)')},
  -(CAST(trunc(-s_acctbal) AS BIGINT) // 12) FROM supplier WHERE s_acctbal < 0"""))
def fn_math(t):
    balance = C("s_acctbal")
    return t.raw("supplier").select(
        "s_suppkey", F.abs(balance).alias("size"), F.greatest(balance, F.lit(15.0)).alias("at_least"),
        X.measure(F.pow("s_suppkey", F.lit(2))).alias("squared"), F.expr("CAST(s_acctbal AS BIGINT) div 12").alias("twelfth"))


@query("fn_random_range", sql(f"""
SELECT s_suppkey, {R("8 + 3 * (CAST('0x' || substr(md5(CAST(s_suppkey AS VARCHAR) || '#7'), 1, 8) AS BIGINT) / 4294967296.0)")} AS noise
FROM supplier"""))
def fn_random_range(t):
    return numbers(t.raw("supplier").select("s_suppkey", X.noise(C("s_suppkey"), 8, 11, seed=7).alias("noise")))


@query("fn_coalesce_nullif", sql("""
SELECT vendor_id, COALESCE(accept_voucher, 0) AS voucher, NULLIF(automatic_calls_delay, 0) AS delay,
  COALESCE(NULLIF(phone, ''), backend_email, 'none') AS reach FROM vendors"""))
def fn_coalesce_nullif(t):
    return t.vendors().select(
        "vendor_id", F.coalesce("accept_voucher", F.lit(0)).alias("voucher"),
        F.nullif(C("automatic_calls_delay"), F.lit(0)).alias("delay"),
        F.coalesce(F.nullif(C("phone"), F.lit("")), C("backend_email"), F.lit("none")).alias("reach"))


@query("fn_cast", sql("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, CAST(o_custkey AS DOUBLE) AS as_double,
  CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS as_money, CAST(o_orderdate AS DATE) AS as_day,
  TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level, TRY_CAST(o_orderstatus AS INTEGER) AS bad FROM orders"""))
def fn_cast(t):
    return t.raw("orders").select(
        "o_orderkey", C("o_orderkey").cast("string").alias("as_text"), C("o_custkey").cast("double").alias("as_double"),
        C("o_totalprice").cast("decimal(20,2)").cast("double").alias("as_money"), F.to_date("o_orderdate").alias("as_day"),
        X.part(C("o_orderpriority"), "-", 1).try_cast("int").alias("level"), C("o_orderstatus").try_cast("int").alias("bad"))


@query("fn_bool_not", sql("""
SELECT city_id, NOT is_test AS real_city, CASE WHEN city_active = 0 THEN NULL ELSE is_test END IS FALSE AS surely_real,
  CASE WHEN city_active = 0 THEN NULL ELSE is_test END IS TRUE AS surely_test, n FROM cities
JOIN (SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = city_id"""))
def fn_bool_not(t):
    vague = F.when(C("city_active") != 0, C("is_test"))
    counts = t.raw("supplier").groupBy(C("s_nationkey").alias("city_id")).agg(F.count(F.lit(1)).alias("n"))
    return t.cities().join(counts, "city_id").select(
        "city_id", (~C("is_test")).alias("real_city"), X.is_false(vague).alias("surely_real"),
        vague.eqNullSafe(F.lit(True)).alias("surely_test"), "n")
