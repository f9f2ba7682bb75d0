"""Operations score: waiting time regression, preparation time and reliability per vendor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import (
    OPS_LADDERS, count_if, ladder, quadratic_score, ratio, regr, round_half_away, shift, sum_if,
)
from partner_analytics.operators.ranking import global_rank, rank_in


@dataclass(frozen=True)
class OpsParams:
    """Defaults of the operations score."""

    days: int = 10
    waiting_time_adjustment: float = 2.4
    minimum_orders: int = 10
    rider_early_tolerance: int = 7
    rider_late_tolerance: int = 8
    waiting_time_threshold: float = 5
    waiting_time_tolerance: float = 0.6
    waiting_time_weight: float = 1
    prep_time_tolerance: float = 15
    prep_time_weight: float = 1
    reliability_tolerance: float = 10
    reliability_weight: float = 1
    busy_utilisation: int = 50
    reliable_offsets: tuple = (-3, 7)


def ops_orders(t, as_of, p: OpsParams = OpsParams()) -> DataFrame:
    """Recent valid orders placed for at once, with waiting time at the door and arrival offset in minutes.

    Four tables of three systems: the order and its status, the dispatch order with its preparation
    estimate, and the completed trip, if there was one. The condition on the trip belongs to the left
    join, so an order without a completed trip stays and has no waiting time; several completed trips
    count as often. Orders are dispatched and delivered after they were placed, so the date bound holds
    for all three tables and reaches their scans. Trips are shuffled once, by the key of the dispatch order.
    """
    since = shift(F.lit(as_of), -p.days, "day")
    valid = t.order_status().where(F.col("valid_order") == 1).select("status_id")
    placed = t.placed_orders().where((F.to_date("order_ts") >= since) & (F.col("preorder") == 0)).join(valid, "status_id").select(
        "tenant_id", "vendor_id", "city_id", "order_id", F.col("order_ts").alias("ts"))
    dispatched = t.dispatch_orders().where(
        (F.to_date("created_ts") >= since) & F.col("prep_min").isNotNull() & F.col("prep_buffer").isNotNull()
    ).select("tenant_id", "order_id", "dispatch_id", "utilisation", "prep_min")
    waiting = round_half_away(F.col("at_door_min"), 1) - F.lit(p.waiting_time_adjustment).cast("decimal(6,2)")
    trips = t.courier_trips().where((F.to_date("ended_ts") >= since) & (F.col("trip_status") == "completed")).select(
        "tenant_id", "dispatch_id", waiting.cast("double").alias("waiting_time"),
        F.col("arrival_offset").cast("double").alias("arrival_offset"), "redelivery")
    travelled = dispatched.join(trips, ["tenant_id", "dispatch_id"], "left")
    return placed.join(travelled, ["tenant_id", "order_id"]).select(
        "tenant_id", "vendor_id", "city_id", "order_id", "ts", "utilisation", "waiting_time", "arrival_offset", "prep_min",
        F.when(F.col("redelivery"), 1).otherwise(0).alias("redelivery"))


def ops_meta(t, as_of, p: OpsParams = OpsParams()) -> DataFrame:
    """Per active vendor: regression of waiting on arrival offset, preparation time and rates.

    Orders are aggregated before vendors are joined.
    """
    orders = ops_orders(t, as_of, p)
    offset, wait = F.col("arrival_offset"), F.col("waiting_time")
    near = offset.between(-p.rider_late_tolerance, p.rider_early_tolerance)
    y = F.greatest(wait, F.lit(0.0))
    slow = (wait > p.waiting_time_threshold) & offset.between(*p.reliable_offsets)
    calm = F.col("utilisation") < p.busy_utilisation
    total = F.count("order_id")
    stats = orders.groupBy("tenant_id", "vendor_id").agg(
        round_half_away(regr("intercept", y, offset, near), 1).cast("double").alias("waiting_time_intercept"),
        round_half_away(regr("slope", y, offset, near), 2).cast("double").alias("waiting_time_slope"),
        round_half_away(ratio(sum_if(F.col("prep_min"), calm), count_if(calm)), 1).cast("double").alias("prep_time_avg"),
        round_half_away(ratio(count_if(slow), F.greatest(total, F.lit(1))) * 100, 1).cast("double").alias("reliability_rate"),
        round_half_away(ratio(F.sum("redelivery"), total) * 100, 3).cast("double").alias("redelivery_rate"),
        total.alias("orders_evaluated"),
    )
    active = t.vendors().where(F.col("vendor_active") == 1).select("tenant_id", "vendor_id", "vendor_code", "city_id")
    return active.join(stats, ["tenant_id", "vendor_id"], "left").fillna(0, ["orders_evaluated", "reliability_rate"])


def ops_scores(t, as_of, p: OpsParams = OpsParams(), ranks: bool = True) -> DataFrame:
    """Quadratic penalties, their sum, ranks by the sum and 0..10 scores.

    The redelivery term is weighted with zero; it only turns the sum NULL where the rate is missing.
    """
    meta = ops_meta(t, as_of, p).where(F.col("orders_evaluated") > p.minimum_orders)
    penalties = (
        meta.withColumn("waiting_penalty", quadratic_score(
            F.col("waiting_time_intercept"), p.waiting_time_tolerance, p.waiting_time_weight))
        .withColumn("prep_penalty", quadratic_score(F.col("prep_time_avg"), p.prep_time_tolerance, p.prep_time_weight))
        .withColumn("reliability_penalty", quadratic_score(
            F.col("reliability_rate"), p.reliability_tolerance, p.reliability_weight))
    )
    silent = round_half_away(F.pow(F.col("redelivery_rate") * 10, F.lit(2)), 1).cast("double") * 0
    summed = (F.col("waiting_penalty") + F.col("prep_penalty") + F.col("reliability_penalty") + silent)
    scored = (
        penalties.withColumn("overall_penalty", round_half_away(summed, 6).cast("double"))
        .withColumn("vendor_delay_score", ladder(F.col("overall_penalty"), OPS_LADDERS["overall"]))
        .withColumn("reliability_score", ladder(F.col("reliability_penalty"), OPS_LADDERS["reliability"]))
        .withColumn("prep_time_score", ladder(F.col("prep_penalty"), OPS_LADDERS["prep_time"]))
        .withColumn("waiting_time_score", ladder(F.col("waiting_penalty"), OPS_LADDERS["waiting"]))
    )
    if not ranks:
        return scored
    everywhere = global_rank(scored, "overall_penalty", "global_rank")
    return rank_in(everywhere, ["tenant_id"], "overall_penalty", "country_rank")
