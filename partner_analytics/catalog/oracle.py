"""SQL definitions of the canonical tables, and helpers to write oracle texts."""

from __future__ import annotations

import re


def R(expr: str, n: int = 6) -> str:
    """The SQL twin of ``measure``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def switch(missing: int, off: int, key: str = "s_suppkey") -> str:
    return f"CASE WHEN {key} % {missing} = 0 THEN NULL WHEN {key} % {off} = 0 THEN 0 ELSE 1 END"


def bit(n: int) -> str:
    return f"CAST((s_suppkey // {2 ** n}) % 2 AS INTEGER)"


TABLES: dict[str, str] = {}

TABLES["countries"] = """
SELECT r_regionkey AS tenant_id, r_name AS country_name, upper(substr(r_name,1,2)) AS country_iso,
  1 AS live, r_regionkey <> 4 AS managed, CASE WHEN r_regionkey < 2 THEN 'Second' ELSE 'First' END AS company FROM region"""

TABLES["cities"] = """
SELECT n_regionkey AS tenant_id, n_nationkey AS city_id, n_name AS city_name,
  CASE WHEN n_nationkey % 11 <> 0 THEN 1 ELSE 0 END AS city_active, n_nationkey = 24 AS is_test
FROM nation"""

TABLES["order_status"] = """
SELECT * FROM (VALUES ('F',1,1,0),('O',1,1,0),('P',0,1,1))
  AS t(status_id, valid_order, gross_order, failed_order_vendor)"""

TABLES["vendors"] = f"""
SELECT n_regionkey AS tenant_id, s_suppkey AS vendor_id, 'v' || CAST(s_suppkey AS VARCHAR) AS vendor_code,
  s_name AS vendor_name, s_nationkey AS city_id,
  CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS brand,
  CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS vendor_active,
  CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END AS vendor_deleted,
  CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS vendor_testing,
  {switch(11, 5)} AS accept_voucher, {switch(19, 7)} AS accept_discount,
  {switch(23, 9)} AS accept_delivery, {switch(29, 6)} AS online_payment,
  {switch(31, 8)} AS automatic_calls_enabled, {switch(10, 7)} AS vat_included,
  CAST(s_suppkey % 5 AS INTEGER) AS automatic_calls_delay,
  CASE s_suppkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  12345  '
    ELSE '0049 ' || CAST(s_suppkey + 1000 AS VARCHAR) END AS phone,
  CAST(s_suppkey % 6 AS INTEGER) AS active_menus,
  CASE s_suppkey % 14 WHEN 0 THEN 'Inactive' WHEN 1 THEN 'Qualified' ELSE 'Active' END AS account_status,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 20 AS INTEGER) END AS chain_id,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'v' || CAST(s_suppkey AS VARCHAR) || '@example.org' END AS backend_email,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'Street ' || CAST(s_suppkey AS VARCHAR) END AS address_line1,
  CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(s_suppkey + 10000 AS VARCHAR) END AS postcode,
  CAST(s_suppkey % 20 AS INTEGER) AS pickup_time, CAST(s_suppkey % 132 AS INTEGER) AS cuisine_id,
  DATE '1995-01-01' + CAST((s_suppkey * 37) % 730 AS INTEGER) AS activation_date,
  'owner_' || CAST(s_suppkey % 8 AS VARCHAR) AS owner
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

TABLES["gmv_classes"] = """
SELECT n_regionkey AS tenant_id, 'v' || CAST(s_suppkey AS VARCHAR) AS vendor_code, company,
  CASE WHEN s_acctbal >= 6000 THEN 'A' WHEN s_acctbal >= 2000 THEN 'B' ELSE 'C' END || CASE company WHEN 'First' THEN '' ELSE '2' END AS gmv_class
FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest(['First', 'Second']) AS company) WHERE s_suppkey % 10 <> 9"""

TABLES["home"] = """
SELECT n_regionkey AS tenant_id, s_suppkey AS vendor_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

TABLES["contracts"] = f"""
SELECT s_suppkey AS vendor_id,
  CASE WHEN s_suppkey % 16 = 15 THEN 'Terminated' ELSE 'Activated' END AS contract_status,
  CAST(s_suppkey % 15 + 18 AS DOUBLE) / CAST(100 AS DOUBLE) AS commission_pct,
  CAST(s_suppkey % 4 AS INTEGER) AS flat_fee,
  {bit(0)} AS price_mark_up, {bit(1)} AS exclusivity, {bit(2)} AS door_sticker,
  {bit(3)} AS voucher_cards, {bit(4)} AS display, {bit(5)} AS backlink,
  CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS fb_rights,
  CASE WHEN s_suppkey % 21 = 0 THEN 1 ELSE 0 END AS no_fb,
  CAST(floor(abs(s_acctbal) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS facebook_likes,
  CAST(s_suppkey % 5 AS INTEGER) AS packaging_quality, CAST(s_suppkey % 8 AS INTEGER) AS photo_stage,
  CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE 'www.v' || CAST(s_suppkey AS VARCHAR) END AS website
FROM supplier"""

TABLES["accounts"] = """
SELECT p_partkey AS account_id, p_brand AS account_name, replace(p_name, ' ', ';') AS competitors,
  CASE WHEN p_partkey % 20 = 0 THEN p_partkey // 20 END AS vendor_id FROM part"""

TABLES["supply_terms"] = """
SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 6 = 5 THEN 0 ELSE 1 END AS auto_supply,
  'Bill ' || CAST(s_suppkey AS VARCHAR) AS billing_street, CAST(s_suppkey + 20000 AS VARCHAR) AS billing_postcode,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST((s_suppkey * 13) % 300 AS INTEGER) END AS check_stock,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '2001-07-16' - CAST(s_suppkey % 40 AS INTEGER) END AS check_date
FROM supplier"""

TABLES["shipping_addresses"] = """
SELECT n_regionkey AS tenant_id, 'v' || s_suppkey AS vendor_code, 'Town ' || (s_suppkey % 7) AS shipping_city,
  CASE WHEN s_suppkey % 5 <> 0 THEN '0049 ' || (s_suppkey + 500) END AS shipping_phone, 'Dock ' || s_suppkey AS shipping_street,
  CAST(s_suppkey + 30000 AS VARCHAR) AS shipping_postcode, """ + ", ".join(
    f"CASE WHEN s_suppkey % {i + 2} <> 0 THEN (s_suppkey % 4 + 8) || '-17' END AS times_{day}"
    for i, day in enumerate("monday tuesday wednesday thursday friday saturday".split())) + """
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 13 <> 12"""

TABLES["stock_reports"] = """
SELECT event_id AS report_id, tenant_id, vendor_id, CAST(ts AS DATE) AS report_date, CAST(event_id * 11 % 400 AS INTEGER) AS reported_stock
FROM events JOIN home ON vendor_id = user_id WHERE event_type = 'signup' AND user_id % 3 <> 0"""

TABLES["crm_accounts"] = """
SELECT s_suppkey AS vendor_id, 'CRM0000000' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS crm_id,
  'Account ' || CAST(s_suppkey AS VARCHAR) AS account_name,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE 'user_' || CAST(s_suppkey % 8 AS VARCHAR) END AS user_id FROM supplier"""

TABLES["newsletter_contacts"] = """
SELECT 'v' || CAST(c_custkey // 15 AS VARCHAR) AS vendor_code, lower(c_name) || '@example.org' AS email,
  c_custkey AS contact_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS excluded
FROM customer"""

TABLES["vendor_orders"] = """
SELECT f.*, v.tenant_id, v.city_id, v.brand FROM (
  SELECT l_orderkey AS order_id, l_suppkey AS vendor_id, o_custkey AS customer_id, o_orderdate AS order_ts,
    CAST(o_orderdate AS DATE) AS order_day, o_orderstatus AS status_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'pickup' ELSE 'delivery' END AS expedition_type,
    CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS first_order, l_orderkey % 4 <> 0 AS tracked,
    SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS gfv,
    SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
        * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS gmv,
    MAX(l_quantity) - 30 AS vendor_late_min, MIN(l_linenumber) * 3 - 6 AS courier_late_min,
    MIN(l_quantity) / 8 AS confirm_minutes, list_sort(list(DISTINCT l_linenumber + 50)) AS code_array
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority) f
JOIN vendors v ON v.vendor_id = f.vendor_id"""

TABLES["order_products"] = """
SELECT l_orderkey AS order_id, l_suppkey AS vendor_id, CAST(l_quantity AS INTEGER) AS quantity,
  o_orderdate AS order_ts, CAST(o_orderdate AS DATE) AS order_day, o_orderstatus AS status_id,
  p_name AS product, tenant_id, brand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN vendors ON l_suppkey = vendor_id"""

TABLES["content"] = """
SELECT vendor_id, products, 6 + vendor_id % 11 AS menucategories,
  greatest(products - CAST(floor((vendor_id % 7) * products / 10) AS BIGINT), 0) AS described
FROM (SELECT l_suppkey AS vendor_id, COUNT(DISTINCT l_partkey) AS products FROM lineitem GROUP BY 1)"""

TABLES["stock"] = """
SELECT l_suppkey AS vendor_id, CAST(l_shipdate AS DATE) AS product_date, CASE l_returnflag
  WHEN 'A' THEN 'Above Average (1.5 Bags per Order)' WHEN 'N' THEN 'Normal (1 - 1.5 per Order)' ELSE 'Low usage' END AS consumption,
  CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem"""

TABLES["crm_products"] = """
SELECT l_suppkey AS vendor_id, l_linestatus AS phase, p_name || ' ' || p_brand AS product_name,
  p_type || ' ' || p_brand AS opportunity_type
FROM lineitem JOIN part ON l_partkey = p_partkey"""

TABLES["opportunities"] = """
SELECT o_orderkey AS opportunity_id, o_custkey AS account_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Partner - Commission Renegotiation'
    WHEN '2-HIGH' THEN 'Partner - Gain Exclusivity' WHEN '3-MEDIUM' THEN 'Partner - FB Advertiser Rights'
    WHEN '4-NOT SPECIFIED' THEN 'Partner - OM Backlink' ELSE 'Partner - In-Restaurant Material' END AS record_type,
  CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'New' ELSE 'Closed Lost' END AS stage,
  CAST(o_orderdate AS DATE) AS created_date, 'owner_' || CAST(c_nationkey % 8 AS VARCHAR) AS owner,
  CAST(o_totalprice AS DECIMAL(12,2)) AS value, o_custkey // 15 AS vendor_id,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS close_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'automation' ELSE 'person' END AS created_by,
  CASE WHEN o_orderkey % 4 = 0 THEN 'automation' ELSE 'person' END AS modified_by,
  CASE o_orderkey % 3 WHEN 0 THEN 'Upgrade' WHEN 1 THEN 'Downgrade' ELSE 'Renewal' END AS contract_source
FROM orders JOIN customer ON o_custkey = c_custkey"""

TABLES["contacts"] = """
SELECT event_id % 5 AS tenant_id, event_id AS order_id, CASE event_type WHEN 'error' THEN '3. Post-Delivery :: 3B. Missing item'
  WHEN 'click' THEN '3. Post-Delivery :: 3C. Wrong item' WHEN 'view' THEN '3. Post-Delivery :: 3D. Food quality'
  WHEN 'purchase' THEN '3. Post-Delivery :: 3E. Damaged packaging' ELSE '1. Pre-Order :: 1A. Other' END AS reason
FROM events"""

TABLES["schedules"] = """
SELECT vendor_id, isodow(day) AS weekday, start_s, CASE WHEN stop_s >= 86000 THEN 0 ELSE stop_s END AS stop_s
FROM (SELECT user_id AS vendor_id, CAST(ts AS DATE) AS day,
  MIN(hour(ts)*3600 + minute(ts)*60 + second(ts)) AS start_s,
  MAX(hour(ts)*3600 + minute(ts)*60 + second(ts)) AS stop_s FROM events GROUP BY 1, 2)"""

TABLES["offline"] = """
SELECT user_id AS vendor_id, CAST(ts AS DATE) AS report_date,
  COUNT(*) FILTER (WHERE event_type = 'error') AS closed_hours,
  COUNT(*) FILTER (WHERE event_type = 'signup') AS declined_hours, COUNT(*) AS open_hours
FROM events GROUP BY 1, 2"""

TABLES["funnel"] = """
SELECT user_id AS vendor_id, CAST(ts AS DATE) AS report_date,
  COUNT(*) FILTER (WHERE event_type IN ('view','click')) AS cr3_start,
  COUNT(*) FILTER (WHERE event_type = 'purchase') AS cr3_end
FROM events GROUP BY 1, 2"""

TABLES["surveys"] = """
SELECT 'panel_' || lower(CASE user_id % 5 WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU'
  ELSE 'MI' END) AS venture_name, event_id AS last_order_id, CAST(event_id % 11 AS INTEGER) AS recommendation,
  CAST(ts AS DATE) AS submitted,
  CASE WHEN event_type IN ('view','click') THEN 'Packaging' ELSE 'Speed' END AS reason
FROM events"""

TABLES["deliveries"] = """
SELECT event_id AS delivery_id, user_id AS vendor_id, ts, value / 10 AS at_door_min,
  CAST((event_id * 7) % 31 - 15 AS INTEGER) AS arrival_offset, CAST(event_id % 25 + 10 AS INTEGER) AS prep_min,
  CAST(event_id % 100 AS INTEGER) AS utilisation, event_type = 'signup' AS redelivery,
  CAST((event_id * 5) % 23 - 8 AS INTEGER) AS courier_late_min,
  CAST((event_id * 3) % 29 - 12 AS INTEGER) AS vendor_late_min, value / 4 - 6 AS pickup_delay_min,
  CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS preorder, CAST(event_id % 4 AS INTEGER) AS prep_buffer,
  ts - to_seconds((event_id % 40) * 61) AS confirm_ts,
  CASE WHEN user_id % 4 <> 0 THEN CAST(event_id % 25 + 10 AS INTEGER) END AS prep_setting
FROM events"""

TABLES["placed_orders"] = """
SELECT v.tenant_id, v.city_id, v.brand, event_id AS order_id, user_id AS vendor_id, ts AS order_ts, o_orderstatus AS status_id, o_totalprice AS gfv,
  CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS preorder, ts - to_seconds((event_id % 40) * 61) AS confirm_ts
FROM events JOIN orders ON o_orderkey = event_id JOIN vendors v ON v.vendor_id = user_id"""

TABLES["dispatch_orders"] = """
SELECT h.tenant_id, event_id * 2 + 1 AS dispatch_id, event_id AS order_id, user_id AS vendor_id, ts AS created_ts, ts AS delivered_ts, ts AS picked_ts,
  CASE WHEN event_id % 13 = 0 THEN 'cancelled' ELSE 'completed' END AS dispatch_status,
  CASE WHEN event_id % 17 = 0 THEN 'external' WHEN event_id % 3 = 0 THEN 'ours' ELSE 'OURS' END AS platform,
  CAST(event_id % 100 AS INTEGER) AS utilisation, CAST(event_id % 25 + 10 AS INTEGER) AS prep_min,
  CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 4 AS INTEGER) END AS prep_buffer,
  CAST((event_id * 5) % 23 - 8 AS INTEGER) AS courier_late_min, CAST((event_id * 3) % 29 - 12 AS INTEGER) AS vendor_late_min,
  value / 4 - 6 AS pickup_delay_min
FROM events LEFT JOIN home h ON h.vendor_id = user_id"""

TABLES["courier_trips"] = """
SELECT h.tenant_id, event_id * 2 + no AS trip_id, event_id * 2 + 1 AS dispatch_id, user_id AS vendor_id, ts AS ended_ts,
  CASE WHEN no = 1 THEN 'failed' WHEN event_id % 9 = 0 THEN 'cancelled' ELSE 'completed' END AS trip_status,
  event_type = 'signup' AS redelivery, value / 10 + no AS at_door_min, CAST((event_id * 7) % 31 - 15 AS INTEGER) AS arrival_offset
FROM events JOIN (SELECT unnest([0, 1]) AS no) ON no = 0 OR event_id % 6 = 0 LEFT JOIN home h ON h.vendor_id = user_id"""

TABLES["prep_buckets"] = """
SELECT r_regionkey AS tenant_id, weekday, CAST(slot AS DOUBLE) * 0.5 AS half_hour,
  CASE WHEN weekday >= 6 THEN 'weekend' ELSE 'week' END || '-' ||
  CASE WHEN slot BETWEEN 22 AND 28 THEN 'lunch' WHEN slot BETWEEN 36 AND 44 THEN 'dinner' ELSE 'calm' END AS bucket
FROM region, (SELECT unnest(range(1, 8)) AS weekday), (SELECT unnest(range(0, 48)) AS slot)"""

# Valid orders and the status flags are used all over.
TABLES["flagged_orders"] = """
SELECT o.*, s.valid_order, s.gross_order, s.failed_order_vendor
FROM vendor_orders o JOIN order_status s ON o.status_id = s.status_id"""


def _needed(text: str, seen: list[str]) -> None:
    for name in TABLES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(TABLES[name], seen)
            if name not in seen:
                seen.append(name)


def sql(body: str) -> str:
    """Prefix ``body`` with the definitions of the canonical tables it mentions."""
    names: list[str] = []
    _needed(body, names)
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def define(name: str, text: str) -> str:
    """Add a named building block for longer oracle texts."""
    TABLES[name] = text
    return name
