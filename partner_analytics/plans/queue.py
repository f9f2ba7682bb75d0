"""Opportunity queue per owner: what is open, what fits the budget, and the upload rows.

The queue starts from the achievable list, which holds at most a few hundred rows per owner, so
its windows by owner stay small by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.functions import concat_strict, id15, part
from partner_analytics.operators.aggregates import with_group
from partner_analytics.operators.ranking import latest
from partner_analytics.plans.opportunities import BACKLINK, COMMISSION, FB_RIGHTS, MATERIAL, PREP_TIME
from partner_analytics.sources.lookups import opportunity_params

# CRM stages that end an opportunity.
CLOSED = ["Closed Won", "Closed Lost", "Agreed", "Photo Shoot Completed", "Photos Edited", "Photos Uploaded"]
# Rank given to rows that must not be taken, and the rank a row must stay below.
LAST, CUT = 1000, 100


def open_opps(t, as_of, owners: list[str] | None = None) -> DataFrame:
    """The newest opportunity per account and type of active accounts, where it is still open and within its lifespan."""
    params = opportunity_params(t.spark)
    known = t.opportunities().join(params.select(F.col("opportunity").alias("record_type")), "record_type", "left_semi")
    newest = latest(known, ["account_id", "record_type"], ["created_date", "opportunity_id"],
                    ["opportunity_id", "created_date", "stage", "owner", "tenant_id", "vendor_id"])
    active = t.vendors().where(F.col("account_status") == "Active").select("tenant_id", "vendor_id")
    rows = newest.join(active, ["tenant_id", "vendor_id"], "left_semi").join(params, F.col("record_type") == F.col("opportunity"))
    age = F.datediff(F.lit(as_of), F.col("created_date"))
    still = rows.where(~F.col("stage").isin(CLOSED) & (age < F.col("lifespan_days")))
    if owners is not None:
        still = still.where(F.col("owner").isin(owners))
    slim = still.select("owner", "account_id", "record_type", "opportunity_id", "created_date", "stage", "opportunity_points")
    return with_group(slim, ["owner", "record_type"], {"open_per_type": F.count(F.lit(1))})


def owner_points(open_rows: DataFrame) -> DataFrame:
    return open_rows.groupBy("owner").agg(F.sum("opportunity_points").alias("open_points"))


def queue(achievable: DataFrame, open_rows: DataFrame, small_budget: list[str] = (), budget: int = 25,
          reduced: int = 15) -> DataFrame:
    """Rank overrides, caps per type, the area rule, and running points per owner.

    Where an owner has no open item of a type its count is NULL, so a rule that adds it never
    fires. Counts run over ties: equal values share one count.
    """
    params = opportunity_params(achievable.sparkSession)
    per_type = open_rows.groupBy("owner", F.col("record_type").alias("opportunity")).agg(
        F.max("open_per_type").alias("open_per_type"))
    rows = (
        achievable.where(F.col("kpi_value").isNotNull())
        .join(params.select("opportunity", "opportunity_points", "lifespan_days", "opportunity_area", "record_type_id"),
              "opportunity", "left")
        .join(owner_points(open_rows), "owner", "left")
        .join(per_type, ["owner", "opportunity"], "left")
    )

    def upto(*keys):
        return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(F.col("value").desc_nulls_first()))

    kind, total = F.col("opportunity"), F.col("upto_type") + F.col("open_per_type")
    counted = rows.withColumns({
        "upto_type": upto("owner", "opportunity"),
        "upto_vendor": upto("owner", "opportunity", "vendor_name"),
        "upto_area": upto("tenant_id", "vendor_code", "opportunity_area"),
        "amount_running_total": F.count(F.lit(1)).over(Window.partitionBy("owner", "opportunity").orderBy("rank")),
    })
    capped = counted.withColumns({
        "rank_2": F.when((F.col("opportunity_area") == "Marketing") & (F.col("upto_area") > 1), LAST)
        .otherwise(F.col("rank")),
        "rank": F.when((kind == FB_RIGHTS) & (total <= 2) & (F.col("score") <= 6), 1)
        .when((kind == COMMISSION) & (total >= 6), LAST)
        .when((kind == MATERIAL) & (F.col("upto_vendor") >= 2), LAST)
        .when((kind == PREP_TIME) & (F.col("upto_type") >= 10), LAST)
        .when((kind == BACKLINK) & (F.col("upto_type") >= 4), LAST)
        .otherwise(F.col("rank")),
        "available_points": F.when(F.col("owner").isin(list(small_budget)), F.lit(reduced)).otherwise(F.lit(budget))
        - F.coalesce("open_points", F.lit(0)),
    })
    open_ranks = capped.where((F.col("rank_2") < CUT) & (F.col("rank") < CUT))
    place = F.when(F.col("rank_2") >= F.col("rank"), F.col("rank_2")).otherwise(F.col("rank"))
    w = Window.partitionBy("owner").orderBy(place.asc_nulls_last())
    return open_ranks.withColumn("points_running_total", F.sum("opportunity_points").over(w)).select(
        "tenant_id", "owner", "available_points", "vendor_id", "vendor_code", "opportunity", "kpi", "kpi_value",
        "opportunity_points", "lifespan_days", "record_type_id", "value", "description", "rank", "rank_2", "score",
        "amount_running_total", "open_per_type", "points_running_total")


def mass_upload(t, queued: DataFrame, as_of, min_value: float = 500, max_score: int = 4) -> DataFrame:
    """Upload rows of what fits the budget; owners without a CRM user are left out."""
    accounts = t.crm_accounts()
    fits = F.col("points_running_total") <= F.col("available_points")
    worth = F.when(F.col("opportunity") != FB_RIGHTS, F.col("value") >= min_value).otherwise(F.col("score") <= max_score)
    rows = queued.where(fits & worth).join(accounts, ["tenant_id", "vendor_id"], "left").where(F.col("user_id").isNotNull())
    # Closing sentence of the upload text.
    deadline = concat_strict(
        F.col("description"), F.lit("Please close this opportunity before "),
        F.date_add(F.lit(as_of), F.col("lifespan_days")),
        F.lit(' otherwise it will automatically be set to "Closed Lost".'))
    return rows.select(
        F.col("owner").alias("am_name"), "opportunity", "record_type_id", F.lit(as_of).alias("close_date"),
        F.lit("New").alias("stage"), id15(F.col("crm_id")).alias("account_id"),
        concat_strict(F.col("account_name"), F.lit(" - "), part(F.col("opportunity"), " - ", 2)).alias("opportunity_name"),
        F.col("user_id").alias("owner_id"), deadline.alias("description"), "value")
