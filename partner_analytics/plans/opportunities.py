"""From scores to pursuable opportunities, and what became of past ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import (
    any_eq, concat_skip, concat_strict, like_any, part, pct_text, period_start, round_half_away, shift, to_array,
)
from partner_analytics.operators.aggregates import rollup_max
from partner_analytics.operators.joins import join_all
from partner_analytics.operators.ranking import top_n
from partner_analytics.operators.sets import unpivot
from partner_analytics.plans.weights import KPI_IMPACT
from partner_analytics.sources.lookups import opportunity_params

VENDOR = ["tenant_id", "vendor_id"]
# CRM record types.
COMMISSION = "Partner - Commission Renegotiation"
EXCLUSIVITY = "Partner - Gain Exclusivity"
FB_RIGHTS = "Partner - FB Advertiser Rights"
MATERIAL = "Partner - In-Restaurant Material"
BACKLINK = "Partner - OM Backlink"
AUTOMATION = "Partner - Automation Improvement"
CANCELLATIONS = "Partner - Improve Cancellations"
PREP_TIME = "Partner - Improvement Prep-Time/Vendor Delay"
OFFLINE = "Partner - Improve Offline Hours"
COMPLAINTS = "Partner - Improve Customer Complaints"
# Labels of the opportunity list.
PURSUABLE, BLOCKED, BLOCKED_SHORT = "Pursuable Opportunity", "Non Pursuable Opportunity", "Non Pursuable"
# Months without a new opportunity of the type; chains wait longer for the major ones.
COOLDOWN = {"backlink": (BACKLINK, 2, 2), "fb": (FB_RIGHTS, 2, 2), "commission": (COMMISSION, 3, 6),
            "excl": (EXCLUSIVITY, 3, 6), "material": (MATERIAL, 1, 1)}
OPS_TYPES = {"prep_time_opp": PREP_TIME, "automation_opp": AUTOMATION, "cancel_opp": CANCELLATIONS}
# KPI whose weights value an opportunity type
TYPE_KPI = {
    COMMISSION: "revenue", EXCLUSIVITY: "exclusivity", FB_RIGHTS: "facebook", MATERIAL: "door_sticker",
    BACKLINK: "backlink", AUTOMATION: "automation", CANCELLATIONS: "cancellations", PREP_TIME: "vendor_delay",
    OFFLINE: "closing_hours", COMPLAINTS: "customer_complaints",
}


def cooldown(t, as_of) -> DataFrame:
    """1 per type a vendor or any vendor of its chain was offered recently.

    Opportunities shrink to the newest one per vendor and type before vendors are joined.
    """
    types = [kind for kind, _, _ in COOLDOWN.values()]
    newest = t.opportunities().where(F.col("record_type").isin(types)).groupBy(*VENDOR, "record_type").agg(
        F.max("created_date").alias("newest"))
    chain = F.coalesce(F.col("chain_id").cast("string"), F.col("vendor_code"))
    vendors = t.vendors().select(
        "tenant_id", "vendor_id", "vendor_code", chain.alias("chain"), F.col("chain_id").isNotNull().alias("chained"))
    rows = newest.join(vendors, VENDOR)

    def since(months: int) -> Column:
        return F.col("newest") >= shift(F.lit(as_of), -months, "month")

    recent, marks = F.lit(False), []
    for name, (kind, single, chained) in COOLDOWN.items():
        inside = (F.col("record_type") == kind) & F.when(F.col("chained"), since(chained)).otherwise(since(single))
        recent = recent | inside
        marks.append(F.when(F.col("record_type") == kind, 1).otherwise(0).alias(f"{name}_opp"))
    flagged = rows.where(recent).select("tenant_id", "chain", "vendor_id", "vendor_code", *marks)
    return rollup_max(flagged, ["vendor_id", "vendor_code"], ["tenant_id", "chain"], [f"{n}_opp" for n in COOLDOWN])


def negotiations(t, as_of, recent_months: int = 6) -> DataFrame:
    """Vendors with a scheduled contract change, or with a renegotiated commission lately."""
    rows = t.opportunities()
    future = (F.col("contract_source").isin("Upgrade", "Downgrade") & (F.col("created_date") >= F.lit(as_of))
              & (F.col("stage") == "New"))
    recent = ((F.col("record_type") == COMMISSION) & (F.col("stage") == "Closed Won")
              & F.col("close_date").between(shift(F.lit(as_of), -recent_months, "month"), F.lit(as_of)))
    marked = rows.where(future | recent).groupBy(*VENDOR).agg(
        F.max(F.when(future, 1).otherwise(0)).alias("future_change"),
        F.max(F.when(recent, 1).otherwise(0)).alias("renegotiated"))
    return t.vendors().select(*VENDOR).join(marked, VENDOR)


def competitor(t, names: list[str]) -> DataFrame:
    """Accounts that name competitors, with a flag for the given ones."""
    listed = any_eq(to_array(F.col("competitors"), ";"), names)
    return t.accounts().where(F.col("competitors").isNotNull()).select(
        "account_id", *VENDOR, F.when(listed, 1).otherwise(0).alias("partner_competitor"))


def ops_open(t, as_of, types: dict[str, str] = OPS_TYPES) -> DataFrame:
    """Operational opportunities created since Monday of last week, as flags per vendor."""
    start = period_start(shift(F.lit(as_of), -1, "week"), "week")
    rows = t.opportunities().where(F.col("record_type").isin(list(types.values())) & (F.col("created_date") >= start))
    flags = rows.groupBy(*VENDOR).agg(*[
        F.when(F.count(F.when(F.col("record_type") == kind, 1)) >= 1, 1).otherwise(0).alias(name)
        for name, kind in types.items()])
    return t.vendors().select(*VENDOR).join(flags, VENDOR)


def pursuability(t, as_of, competitors: list[str], big_chains: list[str], ops_types: dict = OPS_TYPES) -> DataFrame:
    """Everything that blocks an opportunity, per vendor; big chains are always blocked.

    ``big_chains`` holds LIKE patterns on the vendor name.
    """
    keys = ["tenant_id", "vendor_id"]
    names = [f"{n}_opp" for n in COOLDOWN]
    rival = competitor(t, competitors).where(F.col("vendor_id").isNotNull()).groupBy(*VENDOR).agg(
        F.max("partner_competitor").alias("partner_competitor"))
    talks = negotiations(t, as_of).select(*keys, F.lit(1).alias("talks"))
    wide = join_all(
        t.vendors().select(*keys, "vendor_code", "vendor_name"),
        [talks, cooldown(t, as_of).select(*keys, *names), ops_open(t, as_of, ops_types)], keys,
    ).join(rival, VENDOR, "left")
    big = like_any(F.col("vendor_name"), big_chains)
    return wide.withColumns({
        "np_commission": F.coalesce("talks", F.lit(0)),
        **{n: F.when(big, 1).otherwise(F.col(n)) for n in names},
    }).drop("talks")


# Texts of the opportunity list; {name} and {code} stand for the vendor.
INTRO = "Required action: Please follow up with restaurant {name} ({code}). "
TEXTS = {
    "commission": "Commission last week was {value}.",
    "exclusivity": "Exclusivity last week was {not}implemented.",
    "FB": "Fb last week was {not}implemented properly.",
    "Door stickers": "Door stickers last week was not implemented properly.",
    "display": "Display last week was not implemented properly.",
    "Backlink": "Backlink is currently not implemented.",
    "Automation": "Automation last week was {value}%.",
    "Cancellations": "Cancellations last week was {value}%.",
    "Vendor delay": "Reliability rate las week was {value}%, and expected waiting time of the rider at restaurant was "
                    "{value2} minutes.",
    "Offline Hours": "Offline Hours last week was {value}%.",
    "Customer Complaints": "Customer Complaints last week was {value}%.",
}


def text(template: str, **slots: Column) -> Column:
    """Fill ``{slot}`` marks; a NULL slot makes the whole text NULL."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), slots[name]]
    return concat_strict(*pieces, F.lit(rest))


def one_decimal(c: Column) -> Column:
    return round_half_away(c, 1).cast("decimal(20,1)").cast("string")


def opportunity_specs() -> list[tuple[dict[str, Column], Column]]:
    """One entry per list item: its columns and the condition of its rows."""
    c = F.col
    young = c("three_month_flag") == 0

    def item(opportunity, kpi, name, shown, blocked=None, label=BLOCKED, where=None, **slots):
        state = F.lit(PURSUABLE) if blocked is None else F.when(blocked, label).otherwise(PURSUABLE)
        described = text(INTRO + TEXTS[kpi], name=c("vendor_name"), code=c("vendor_code"), **slots)
        columns = {
            "pursuability": state, "opportunity": F.lit(opportunity), "value": c(f"{name}_impact").cast("double"),
            "score": c(f"{name}_score").cast("int"), "kpi": F.lit(kpi), "kpi_value": shown, "description": described,
        }
        return columns, F.lit(True) if where is None else where

    def negated(flag):
        return F.when(c(flag) == 1, "").otherwise(" not ")

    pct, auto, cancel = c("commission_pct"), c("automated_orders_perc"), c("cancellations")
    closed, complained = c("closing_hours"), c("complaint_rate")
    return [
        item(COMMISSION, "commission", "revenue", pct_text(pct),
             (c("np_commission") == 1) | (c("commission_opp") == 1) | young,
             where=(pct < 0.3) & (pct > 0.01), value=pct_text(pct)),
        item(EXCLUSIVITY, "exclusivity", "exclusivity", c("exclusivity").cast("string"),
             (c("excl_opp") == 1) | young | (c("partner_competitor") == 1), **{"not": negated("exclusivity")}),
        item(FB_RIGHTS, "FB", "facebook", c("fb_rights").cast("string"),
             (c("fb_opp") == 1) | young, **{"not": negated("fb_rights")}),
        item(MATERIAL, "Door stickers", "door_sticker", c("door_sticker").cast("string"), c("material_opp") == 1),
        item(MATERIAL, "display", "display", c("display").cast("string"), c("material_opp") == 1),
        item(BACKLINK, "Backlink", "backlink", c("backlink").cast("string"), (c("backlink_opp") == 1) | young),
        item(AUTOMATION, "Automation", "automation", pct_text(auto), c("automation_opp") == 1, BLOCKED_SHORT,
             auto < 0.90, value=one_decimal(auto * 100)),
        item(CANCELLATIONS, "Cancellations", "cancellations", pct_text(cancel), c("cancel_opp") == 1, BLOCKED_SHORT,
             cancel >= 0.05, value=one_decimal(cancel * 100)),
        item(PREP_TIME, "Vendor delay", "vendor_delay", pct_text(c("vendor_delay")),
             (c("vendor_delay_score") >= 8) | (c("prep_time_opp") == 1),
             value=one_decimal(c("reliability_rate")), value2=one_decimal(c("waiting_time_intercept"))),
        item(OFFLINE, "Offline Hours", "closing_hours", pct_text(closed), where=closed >= 0.20,
             value=one_decimal(closed * 100)),
        item(COMPLAINTS, "Customer Complaints", "customer_complaints", pct_text(complained),
             where=complained >= 0.05, value=one_decimal(complained * 100)),
    ]


def opportunity_rows(card: DataFrame, flags: DataFrame, min_orders: int = 40) -> DataFrame:
    """Every vendor x type of the list, from one pass over the score card.

    ``card`` carries scores and impacts per KPI; ``flags`` what blocks a vendor.
    """
    base = card.where(F.col("impact").isNotNull() & (F.col("valid_orders") >= min_orders))
    joined = base.join(flags.drop("vendor_code", "vendor_name"), ["tenant_id", "vendor_id"], "left")
    specs = opportunity_specs()
    keep = ["tenant_id", "country_name", "city_name", "owner", "vendor_id", "vendor_code", "vendor_name"]
    return unpivot(joined, keep, [s for s, _ in specs], [w for _, w in specs])


def achievable(card: DataFrame, flags: DataFrame, label: str, min_orders: int = 40, top: int = 400,
               min_value: float = 500) -> DataFrame:
    """The long list: best ``top`` rows per owner, then only pursuable ones worth ``min_value``."""
    rows = opportunity_rows(card, flags, min_orders)
    ranked = top_n(rows, ["owner"], "value", ["vendor_code", "kpi"], top)
    kept = ranked.where((F.col("pursuability") == PURSUABLE) & (F.col("value") >= min_value))
    return kept.withColumns({
        "id": concat_skip(F.col("vendor_code"), F.col("tenant_id"), F.col("kpi")), "report_week": F.lit(label)})


# CRM stages that count as won.
WON = ["Closed Won", "Photo Shoot Completed", "Photos Edited", "Photos Uploaded"]


def outcomes(t, period, scores: DataFrame, robot: str = "automation", robot_only: str = BACKLINK) -> DataFrame:
    """Closed opportunities of the period, won or lost, lost ones split by whether somebody tried.

    Untouched is what the ``robot`` user closed exactly one day after the lifespan ran out. Of type
    ``robot_only`` only rows created by the robot count. ``scores`` gives ``impact`` per vendor.
    """
    params = opportunity_params(t.spark).select("opportunity", "opportunity_points", "opportunity_area", "lifespan_days")
    stage = F.col("stage")
    category = (F.when(stage.isin(WON), "Closed Won").when(stage == "New", "New")
                .when(stage == "Closed Lost", "Closed Lost").otherwise("Open"))
    due = F.date_add("created_date", F.col("lifespan_days") + 1)
    untouched = (stage == "Closed Lost") & (F.col("modified_by") == robot) & (F.col("close_date") == due)
    area, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, kpi in TYPE_KPI.items():
        area = F.when(F.col("record_type") == kind, F.lit(KPI_IMPACT[kpi][0])).otherwise(area)
        weight = F.when(F.col("record_type") == kind, F.lit(KPI_IMPACT[kpi][1])).otherwise(weight)
    closed = t.opportunities().where(
        F.col("close_date").between(F.lit(period.start), F.lit(period.end))
        & F.when(F.col("record_type") == robot_only, F.col("created_by") == robot)
        .otherwise(F.col("created_by").isNotNull()))
    rows = closed.join(params, F.col("record_type") == F.col("opportunity")).join(
        scores.select("tenant_id", "vendor_id", "impact"), ["tenant_id", "vendor_id"], "left")
    shown = rows.where(F.col("impact").isNotNull()).select(
        "tenant_id", "vendor_id", "opportunity_id", "owner", F.lit(period.label).alias("report_month"),
        part(F.col("record_type"), " - ", 2).alias("opportunity_type"), category.alias("stage_category"),
        "opportunity_points", "opportunity_area", "impact", (area * weight * F.col("impact")).alias("type_impact"),
        F.when(untouched, 1).otherwise(0).alias("untouched"))
    lost = F.col("stage_category") == "Closed Lost"
    return shown.where(F.col("stage_category").isin("Closed Won", "Closed Lost")).withColumn(
        "stages", F.when(lost & (F.col("untouched") == 1), "Closed Lost untouched")
        .when(lost, "Closed Lost worked on").otherwise("Closed Won"))
