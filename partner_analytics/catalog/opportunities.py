"""Opportunity queries: blocking flags, achievable list, queue, upload, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from partner_analytics.catalog.core import (
    AS_OF, MONTH, STATED_IMPACT, WEEK, day, monthly_card, numbers, weekly_card,
)
from partner_analytics.catalog.oracle import R, define, sql
from partner_analytics.catalog.registry import query
from partner_analytics.plans import opportunities as O
from partner_analytics.plans import queue as Q
from partner_analytics.plans import scorecard

RIVALS = ["red", "bolt"]
BIG_CHAINS = ["Supplier#%7", "%Chain%"]
OPS_TYPES = {"prep_time_opp": O.BACKLINK, "automation_opp": O.COMMISSION, "cancel_opp": O.MATERIAL}
SMALL_BUDGET = ["owner_1", "owner_2"]

MAJOR = f"('{O.COMMISSION}', '{O.EXCLUSIVITY}')"
MINOR = f"('{O.FB_RIGHTS}', '{O.BACKLINK}')"
NAMES = {"backlink": O.BACKLINK, "fb": O.FB_RIGHTS, "commission": O.COMMISSION, "excl": O.EXCLUSIVITY, "material": O.MATERIAL}

define("cooldown_vendor", f"""
SELECT tenant_id, COALESCE(CAST(chain_id AS VARCHAR), vendor_code) AS chain, v.vendor_id, vendor_code,
  {', '.join(f"MAX(CASE WHEN record_type = '{kind}' THEN 1 ELSE 0 END) AS {n}_opp" for n, kind in NAMES.items())}
FROM opportunities o JOIN vendors v ON o.vendor_id = v.vendor_id WHERE CASE
  WHEN chain_id IS NOT NULL AND record_type IN {MAJOR} THEN created_date >= {day(AS_OF)} - INTERVAL 6 MONTH
  WHEN record_type IN {MAJOR} THEN created_date >= {day(AS_OF)} - INTERVAL 3 MONTH
  WHEN record_type IN {MINOR} THEN created_date >= {day(AS_OF)} - INTERVAL 2 MONTH
  WHEN record_type = '{O.MATERIAL}' THEN created_date >= {day(AS_OF)} - INTERVAL 1 MONTH END
GROUP BY 1, 2, 3, 4""")
define("cooldown_all", f"""
SELECT tenant_id, chain, vendor_id, vendor_code,
  {', '.join(f"MAX({n}_opp) OVER (PARTITION BY tenant_id, chain) AS {n}_opp" for n in NAMES)} FROM cooldown_vendor""")
define("negotiations_all", f"""
SELECT v.tenant_id, v.vendor_id, MAX(CASE WHEN future THEN 1 ELSE 0 END) AS future_change,
  MAX(CASE WHEN recent THEN 1 ELSE 0 END) AS renegotiated
FROM (SELECT vendor_id, contract_source IN ('Upgrade', 'Downgrade') AND created_date >= {day(AS_OF)} AND stage = 'New' AS future,
    record_type = '{O.COMMISSION}' AND stage = 'Closed Won' AND close_date >= {day(AS_OF)} - INTERVAL 6 MONTH
      AND close_date <= {day(AS_OF)} AS recent FROM opportunities) o JOIN vendors v ON o.vendor_id = v.vendor_id
WHERE future OR recent GROUP BY 1, 2""")
define("competitor_all", """
SELECT account_id, vendor_id, CASE WHEN list_has_any(string_split(competitors, ';'), ['red', 'bolt']) THEN 1 ELSE 0 END
  AS partner_competitor FROM accounts""")
define("ops_open_all", f"""
SELECT v.tenant_id, v.vendor_id, {', '.join(
    f"CASE WHEN COUNT(*) FILTER (WHERE record_type = '{kind}') >= 1 THEN 1 ELSE 0 END AS {n}" for n, kind in OPS_TYPES.items())}
FROM opportunities o JOIN vendors v ON o.vendor_id = v.vendor_id
WHERE record_type IN ({', '.join(f"'{k}'" for k in OPS_TYPES.values())}) AND created_date >= DATE '2001-07-09' GROUP BY 1, 2""")
define("pursuability_all", f"""
SELECT v.tenant_id, v.vendor_id, v.vendor_code, v.vendor_name, CASE WHEN n.vendor_id IS NULL THEN 0 ELSE 1 END AS np_commission,
  {', '.join(f"CASE WHEN vendor_name LIKE 'Supplier#%7' OR vendor_name LIKE '%Chain%' THEN 1 ELSE {n}_opp END AS {n}_opp" for n in NAMES)},
  partner_competitor, prep_time_opp, automation_opp, cancel_opp
FROM vendors v LEFT JOIN negotiations_all n ON v.vendor_id = n.vendor_id LEFT JOIN cooldown_all c ON v.vendor_id = c.vendor_id
LEFT JOIN (SELECT vendor_id, MAX(partner_competitor) AS partner_competitor FROM competitor_all GROUP BY 1) p ON v.vendor_id = p.vendor_id
LEFT JOIN ops_open_all o ON v.vendor_id = o.vendor_id""")


@query("rpt_opportunity_cooldown", sql("SELECT * FROM cooldown_all"))
def rpt_opportunity_cooldown(t):
    return O.cooldown(t, AS_OF)


@query("rpt_future_negotiations", sql("SELECT * FROM negotiations_all"))
def rpt_future_negotiations(t):
    return O.negotiations(t, AS_OF)


@query("rpt_competitor_flag", sql("SELECT * FROM competitor_all LEFT JOIN home USING (vendor_id)"))
def rpt_competitor_flag(t):
    return O.competitor(t, RIVALS)


@query("rpt_ops_opportunity_flags", sql("SELECT * FROM ops_open_all"))
def rpt_ops_opportunity_flags(t):
    return O.ops_open(t, AS_OF, OPS_TYPES)


def flags(t):
    return O.pursuability(t, AS_OF, RIVALS, BIG_CHAINS, OPS_TYPES)


@query("rpt_pursuability_flags", sql("SELECT * FROM pursuability_all"))
def rpt_pursuability_flags(t):
    return flags(t)


def pct_sql(c: str) -> str:
    return f"CAST(CAST(round_even({c} * 100, 0) AS INTEGER) AS VARCHAR) || '%'"


def dec_sql(c: str) -> str:
    return f"CAST(CAST(ROUND(CAST({c} AS DECIMAL(28,10)), 1) AS DECIMAL(20,1)) AS VARCHAR)"


define("opportunity_base", f"""
SELECT c.*, np_commission, backlink_opp, fb_opp, commission_opp, excl_opp, material_opp, partner_competitor,
  prep_time_opp, automation_opp, cancel_opp, {', '.join(
      f"CAST({a} AS DOUBLE) * CAST({w} AS DOUBLE) * gmv * (10 - {n}_score) AS {n}_impact" for n, (a, w) in STATED_IMPACT.items())}
FROM card_week c LEFT JOIN pursuability_all f ON c.vendor_id = f.vendor_id WHERE impact IS NOT NULL AND valid_orders >= 1""")


def item_sql(opportunity, kpi, name, shown, sentence, blocked="FALSE", label=O.BLOCKED, where="TRUE") -> str:
    return f"""SELECT tenant_id, country_name, city_name, owner, vendor_id, vendor_code, vendor_name,
  CASE WHEN {blocked} THEN '{label}' ELSE '{O.PURSUABLE}' END AS pursuability, '{opportunity}' AS opportunity,
  {name}_impact AS value, {name}_score AS score, '{kpi}' AS kpi, {shown} AS kpi_value,
  'Required action: Please follow up with restaurant ' || vendor_name || ' (' || vendor_code || '). ' || {sentence} AS description
FROM opportunity_base WHERE {where}"""


YOUNG = "three_month_flag = 0"
ITEMS = [
    item_sql(O.COMMISSION, "commission", "revenue", pct_sql("commission_pct"),
             f"'Commission last week was ' || {pct_sql('commission_pct')} || '.'",
             f"np_commission = 1 OR commission_opp = 1 OR {YOUNG}", where="commission_pct < 0.3 AND commission_pct > 0.01"),
    item_sql(O.EXCLUSIVITY, "exclusivity", "exclusivity", "CAST(exclusivity AS VARCHAR)",
             "'Exclusivity last week was ' || CASE WHEN exclusivity = 1 THEN '' ELSE ' not ' END || 'implemented.'",
             f"excl_opp = 1 OR {YOUNG} OR partner_competitor = 1"),
    item_sql(O.FB_RIGHTS, "FB", "facebook", "CAST(fb_rights AS VARCHAR)",
             "'Fb last week was ' || CASE WHEN fb_rights = 1 THEN '' ELSE ' not ' END || 'implemented properly.'",
             f"fb_opp = 1 OR {YOUNG}"),
    item_sql(O.MATERIAL, "Door stickers", "door_sticker", "CAST(door_sticker AS VARCHAR)",
             "'Door stickers last week was not implemented properly.'", "material_opp = 1"),
    item_sql(O.MATERIAL, "display", "display", "CAST(display AS VARCHAR)",
             "'Display last week was not implemented properly.'", "material_opp = 1"),
    item_sql(O.BACKLINK, "Backlink", "backlink", "CAST(backlink AS VARCHAR)",
             "'Backlink is currently not implemented.'", f"backlink_opp = 1 OR {YOUNG}"),
    item_sql(O.AUTOMATION, "Automation", "automation", pct_sql("automated_orders_perc"),
             f"'Automation last week was ' || {dec_sql('automated_orders_perc * 100')} || '%.'",
             "automation_opp = 1", O.BLOCKED_SHORT, "automated_orders_perc < 0.90"),
    item_sql(O.CANCELLATIONS, "Cancellations", "cancellations", pct_sql("cancellations"),
             f"'Cancellations last week was ' || {dec_sql('cancellations * 100')} || '%.'",
             "cancel_opp = 1", O.BLOCKED_SHORT, "cancellations >= 0.05"),
    item_sql(O.PREP_TIME, "Vendor delay", "vendor_delay", pct_sql("vendor_delay"),
             f"'Reliability rate las week was ' || {dec_sql('reliability_rate')} || '%, and expected waiting time of the rider at restaurant was ' || {dec_sql('waiting_time_intercept')} || ' minutes.'",
             "vendor_delay_score >= 8 OR prep_time_opp = 1"),
    item_sql(O.OFFLINE, "Offline Hours", "closing_hours", pct_sql("closing_hours"),
             f"'Offline Hours last week was ' || {dec_sql('closing_hours * 100')} || '%.'", where="closing_hours >= 0.20"),
    item_sql(O.COMPLAINTS, "Customer Complaints", "customer_complaints", pct_sql("complaint_rate"),
             f"'Customer Complaints last week was ' || {dec_sql('complaint_rate * 100')} || '%.'", where="complaint_rate >= 0.05"),
]
define("opportunity_list", " UNION ALL ".join(ITEMS))
define("achievable_all", f"""
SELECT *, vendor_code || CAST(tenant_id AS VARCHAR) || kpi AS id, '{WEEK.label}' AS report_week FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY value DESC NULLS FIRST, vendor_code, kpi) AS rank FROM opportunity_list)
WHERE rank <= 400 AND pursuability = '{O.PURSUABLE}' AND value >= 500""")


def achievable(t):
    card = scorecard.kpi_impact(weekly_card(t))
    return O.achievable(card, flags(t), WEEK.label, min_orders=1)


LIST_COLUMNS = """tenant_id, country_name, city_name, owner, vendor_id, vendor_code, vendor_name, pursuability, opportunity,
  score, kpi, kpi_value, description, rank, id, report_week"""


@query("rpt_achievable_opportunities", sql(f"SELECT {LIST_COLUMNS}, {R('value', 4)} AS value FROM achievable_all"))
def rpt_achievable_opportunities(t):
    return numbers(achievable(t), 4)


define("open_opportunities", f"""
SELECT owner, account_id, record_type, opportunity_id, created_date, stage, opportunity_points,
  COUNT(owner) OVER (PARTITION BY owner, record_type) AS open_per_type
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, record_type ORDER BY created_date DESC, opportunity_id DESC) AS r
      FROM opportunities) b JOIN opportunity_params ON record_type = opportunity
JOIN (SELECT vendor_id FROM vendors WHERE account_status = 'Active') act USING (vendor_id)
WHERE r = 1 AND stage NOT IN ('Closed Won', 'Closed Lost', 'Agreed') AND {day(AS_OF)} - created_date < lifespan_days""")


@query("rpt_open_opportunities", sql("""
SELECT owner, account_id, record_type, opportunity_id, created_date, stage, open_per_type,
  CAST(opportunity_points AS DOUBLE) AS opportunity_points FROM open_opportunities"""))
def rpt_open_opportunities(t):
    return numbers(Q.open_opps(t, AS_OF))


@query("rpt_owner_points", sql("""
SELECT owner, CAST(SUM(opportunity_points) AS DOUBLE) AS open_points FROM open_opportunities GROUP BY 1"""))
def rpt_owner_points(t):
    return numbers(Q.owner_points(Q.open_opps(t, AS_OF)))


define("queue_ranked", f"""
SELECT a.*, p.opportunity_points, p.lifespan_days, p.record_type_id, oo.open_per_type,
  CASE WHEN a.owner IN ('owner_1', 'owner_2') THEN 15 ELSE 25 END - COALESCE(op.points, 0) AS available_points,
  COUNT(*) OVER (PARTITION BY a.owner, a.opportunity ORDER BY a.rank) AS amount_running_total,
  CASE WHEN p.opportunity_area = 'Marketing' AND COUNT(*) OVER (
    PARTITION BY a.tenant_id, a.vendor_code, p.opportunity_area ORDER BY value DESC) > 1 THEN 1000 ELSE a.rank END AS rank_2,
  CASE
    WHEN a.opportunity = '{O.FB_RIGHTS}' AND n_type + open_per_type <= 2 AND score <= 6 THEN 1
    WHEN a.opportunity = '{O.COMMISSION}' AND n_type + open_per_type >= 6 THEN 1000
    WHEN a.opportunity = '{O.MATERIAL}' AND n_vendor >= 2 THEN 1000
    WHEN a.opportunity = '{O.PREP_TIME}' AND n_type >= 10 THEN 1000
    WHEN a.opportunity = '{O.BACKLINK}' AND n_type >= 4 THEN 1000 ELSE a.rank END AS rank_1
FROM (SELECT *, COUNT(*) OVER (PARTITION BY owner, opportunity ORDER BY value DESC) AS n_type,
        COUNT(*) OVER (PARTITION BY owner, opportunity, vendor_name ORDER BY value DESC) AS n_vendor
      FROM achievable_all WHERE kpi_value IS NOT NULL) a
LEFT JOIN opportunity_params p ON a.opportunity = p.opportunity
LEFT JOIN (SELECT owner, SUM(opportunity_points) AS points FROM open_opportunities GROUP BY 1) op ON op.owner = a.owner
LEFT JOIN (SELECT owner, record_type, MAX(open_per_type) AS open_per_type FROM open_opportunities GROUP BY 1, 2) oo
  ON oo.owner = a.owner AND oo.record_type = a.opportunity""")
define("queue_all", """
SELECT *, SUM(opportunity_points) OVER (PARTITION BY owner ORDER BY CASE WHEN rank_2 >= rank_1 THEN rank_2 ELSE rank_1 END) AS points_running_total
FROM queue_ranked WHERE rank_2 < 100 AND rank_1 < 100""")


def queued(t):
    return Q.queue(achievable(t), Q.open_opps(t, AS_OF), SMALL_BUDGET)


@query("rpt_opportunity_queue", sql(f"""
SELECT tenant_id, owner, {R('available_points')} AS available_points, vendor_id, vendor_code, opportunity, kpi, kpi_value,
  {R('opportunity_points')} AS opportunity_points, lifespan_days, record_type_id, {R('value', 4)} AS value, description,
  rank_1 AS rank, rank_2, score, amount_running_total, open_per_type, {R('points_running_total')} AS points_running_total
FROM queue_all"""))
def rpt_opportunity_queue(t):
    return numbers(queued(t), 4)


@query("rpt_mass_upload", sql(f"""
SELECT owner AS am_name, opportunity, record_type_id, {day(AS_OF)} AS close_date, 'New' AS stage, left(crm_id, 15) AS account_id,
  account_name || ' - ' || split_part(opportunity, ' - ', 2) AS opportunity_name, user_id AS owner_id,
  description || 'Please close this opportunity before ' || CAST({day(AS_OF)} + lifespan_days AS VARCHAR) ||
    ' otherwise it will automatically be set to "Closed Lost".' AS description, {R('value', 4)} AS value
FROM queue_all q JOIN crm_accounts c ON q.vendor_id = c.vendor_id
WHERE user_id IS NOT NULL AND points_running_total <= available_points
  AND CASE WHEN opportunity <> '{O.FB_RIGHTS}' THEN value >= 500 ELSE score <= 4 END"""))
def rpt_mass_upload(t):
    return numbers(Q.mass_upload(t, queued(t), AS_OF), 4)


def weight_sql(i: int) -> str:
    arms = " ".join(f"WHEN '{kind}' THEN {STATED_IMPACT[kpi][i]}" for kind, kpi in O.TYPE_KPI.items())
    return f"CAST(CASE record_type {arms} END AS DOUBLE)"


@query("rpt_opportunity_outcome", sql(f"""
SELECT *, CASE WHEN stage_category = 'Closed Lost' AND untouched = 1 THEN 'Closed Lost untouched'
  WHEN stage_category = 'Closed Lost' THEN 'Closed Lost worked on' ELSE 'Closed Won' END AS stages FROM (
SELECT c.tenant_id, o.vendor_id, opportunity_id, o.owner, '{MONTH.label}' AS report_month,
  split_part(record_type, ' - ', 2) AS opportunity_type,
  CASE o.stage WHEN 'Closed Won' THEN 'Closed Won' WHEN 'New' THEN 'New' WHEN 'Closed Lost' THEN 'Closed Lost' ELSE 'Open' END AS stage_category,
  CAST(opportunity_points AS DOUBLE) AS opportunity_points, opportunity_area, {R('c.impact', 4)} AS impact,
  {R(f"{weight_sql(0)} * {weight_sql(1)} * c.impact", 4)} AS type_impact,
  CASE WHEN o.stage = 'Closed Lost' AND modified_by = 'automation' AND close_date = created_date + lifespan_days + 1 THEN 1 ELSE 0 END AS untouched
FROM opportunities o JOIN opportunity_params p ON p.opportunity = o.record_type
JOIN card_month c ON c.vendor_id = o.vendor_id
WHERE strftime(close_date, '%Y-%m') = '{MONTH.label}' AND c.impact IS NOT NULL
  AND CASE WHEN record_type = '{O.BACKLINK}' THEN created_by = 'automation' ELSE created_by IS NOT NULL END)
WHERE stage_category IN ('Closed Won', 'Closed Lost')"""))
def rpt_opportunity_outcome(t):
    return numbers(O.outcomes(t, MONTH, monthly_card(t)), 4)
