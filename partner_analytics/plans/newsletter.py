"""Partner newsletter: four weeks of vendor figures, top dishes, benchmark of the city, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.functions import (
    clamp0, concat_strict, count_if, iso_week_key, measure, noise, overlaps, period_start, ratio,
    round_half_away, rx, shift, sum_if, trunc_n,
)
from partner_analytics.operators.aggregates import period_pivot, pivot_ranked, with_group
from partner_analytics.operators.filters import where_lt
from partner_analytics.operators.joins import join_all
from partner_analytics.operators.ranking import dedupe_first, share, top_n
from partner_analytics.plans.kpis import complaint_orders, flagged_orders
from partner_analytics.sources.lookups import CUISINES, DEFAULT_CUISINE, banners

VENDOR = ["tenant_id", "vendor_id"]
# Contact reasons shown to partners, and the order code of an overdue confirmation.
ISSUES = {"missing": "3B.", "wrong": "3C.", "damaged": "3E."}
OVERDUE_CODE = 53


def new_vendors(t, as_of, oldest_weeks: int = 6, newest_weeks: int = 5) -> DataFrame:
    """Active accounts activated in the week before ``newest_weeks`` ago, counted per country."""
    window = F.col("activation_date").between(
        shift(F.lit(as_of), -oldest_weeks, "week"), shift(shift(F.lit(as_of), -newest_weeks, "week"), -1, "day"))
    rows = t.vendors().where((F.col("account_status") == "Active") & window)
    counted = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("new_vendors"))
    return counted.join(t.countries().select("tenant_id", "country_name"), "tenant_id")


def cleaned_delay(c_late: Column, pickup_delay: Column, redelivery: Column) -> Column:
    """Minutes the vendor kept the courier: all of the pickup delay where the courier was early,
    the rest of it where the courier was up to ten minutes late, unknown otherwise."""
    late = F.when(~redelivery, c_late)
    return F.when(late < 0, pickup_delay).when(late.between(0, 10), pickup_delay - c_late)


def clean_delay(t, as_of, limits: tuple = (5, 10), tenants: list | None = None) -> DataFrame:
    """Valid orders per vendor and week since last Monday but one, and how many of them the vendor delayed.

    Orders lead: those without a completed trip count as valid orders but aren't observed. An order with
    several completed trips counts once, with its longest delay. Only an order's own delay, not its
    trips, meets the orders; both sides are bounded by the date before any shuffle.
    """
    monday = period_start(shift(F.lit(as_of), -1, "week"), "week")
    valid = t.order_status().where(F.col("valid_order") == 1).select("status_id")
    orders = t.placed_orders().where(F.to_date("order_ts") >= monday)
    if tenants is not None:
        orders = orders.where(F.col("tenant_id").isin(tenants))
    trips = t.courier_trips().where((F.to_date("ended_ts") >= monday) & (F.col("trip_status") == "completed")).select(
        "tenant_id", "dispatch_id", "redelivery")
    dispatched = t.dispatch_orders().where(F.to_date("created_ts") >= monday).select(
        "tenant_id", "dispatch_id", "order_id", "courier_late_min", "pickup_delay_min")
    late = cleaned_delay(F.col("courier_late_min"), F.col("pickup_delay_min"), F.col("redelivery"))
    delays = dispatched.join(trips, ["tenant_id", "dispatch_id"]).groupBy("tenant_id", "order_id").agg(F.max(late).alias("_late"))
    counted = orders.join(valid, "status_id").select(*VENDOR, "order_id", "order_ts").join(delays, ["tenant_id", "order_id"], "left")
    return counted.groupBy(*VENDOR, iso_week_key(F.col("order_ts")).alias("week")).agg(
        F.count("order_id").alias("valid_orders"),
        *[count_if(F.col("_late") > n).alias(f"late_over_{n}_min") for n in limits],
        F.count("_late").alias("delay_observations"))


def order_issues(t, period) -> DataFrame:
    """Gross orders of the period, one row each, with 0/1 marks per issue."""
    marks = complaint_orders(t, ISSUES, t.order_ids(period.start, period.end))
    orders = flagged_orders(t, period.start, period.end).where(F.col("gross_order") == 1)
    valid = F.col("valid_order") == 1

    def mark(name: str) -> Column:
        return F.when(valid & (F.col(name) == 1), 1).otherwise(0).alias(name)

    late = F.col("vendor_late_min")
    return orders.join(marks, ["tenant_id", "order_id"], "left").select(
        *VENDOR, "order_id", F.to_date("order_ts").alias("order_day"), "valid_order", "failed_order_vendor",
        "gfv", "first_order", "tracked", F.when(late > 5, late).alias("vendor_late"),
        F.when(overlaps(F.col("code_array"), [OVERDUE_CODE]), 1).otherwise(0).alias("overdue"),
        *[mark(name) for name in ISSUES])


def top_dishes(t, period, excluded: list[str], n: int = 5) -> DataFrame:
    """The ``n`` best sold products per vendor with their share, as columns."""
    lines = t.order_products(period.start, period.end).join(t.order_status(), "status_id")
    kept = lines.where(F.col("valid_order") == 1)
    for pattern in excluded:
        kept = kept.where(~rx(F.col("product"), pattern, ignore_case=False))
    sold = kept.groupBy(*VENDOR, "product").agg(F.sum("quantity").alias("quantity"))
    shares = share(sold, VENDOR, "quantity", "perc").withColumn("perc", F.col("perc").cast("decimal(6,1)"))
    best = top_n(shares, VENDOR, "quantity", ["product"], n)
    return pivot_ranked(best, VENDOR, "rank", {"product": "title", "perc": "quant"}, n,
                        [F.sum("perc").cast("double").alias("total_perc")])


def vendor_weeks(t, period) -> DataFrame:
    """Figures of the period in total and per week, in one pass over the order rows."""
    rows = order_issues(t, period)
    weekly = {
        "valid_orders": F.col("valid_order") == 1, "declined_orders": F.col("failed_order_vendor") == 1,
        "missing_items": F.col("missing") == 1, "wrong_items": F.col("wrong") == 1,
        "damaged_packaging": F.col("damaged") == 1, "vendor_late": F.col("vendor_late").isNotNull(),
    }
    valid = F.col("valid_order") == 1
    return period_pivot(rows, VENDOR, "order_day", period.start, 4, {
        name: ("count", F.when(cond, 1)) for name, cond in weekly.items()}, [
        sum_if(F.col("gfv"), valid).cast("double").alias("gmv_local"),
        ratio(sum_if(F.col("gfv"), valid), count_if(valid)).alias("afv"),
        sum_if(F.col("gfv"), F.col("failed_order_vendor") == 1).cast("double").alias("lost_gfv"),
        count_if(F.col("overdue") == 1).alias("overdue_orders"),
        count_if(F.col("first_order") == 1).alias("new_customers"),
        count_if(F.col("tracked")).alias("tracked_orders")])


def offline_hours(t, start, weeks: int = 4) -> DataFrame:
    """Closed hours the vendor caused itself, on days it was neither open nor closed throughout."""
    rows = where_lt(t.offline(), "closed_hours", "open_hours").where(F.col("closed_hours") > 0)
    own = F.col("closed_hours") - F.col("declined_hours")
    return period_pivot(rows, VENDOR, "report_date", start, weeks, {
        "offline_hours": ("sum", own), "open_hours": ("sum", F.col("open_hours"))}).drop(
        *[f"open_hours_w_{w}" for w in range(1, weeks + 1)])


def banner(t) -> DataFrame:
    """Banner file of every active vendor by its main cuisine. The lookup has under 100 rows."""
    files = banners(t.spark)
    vendors = t.vendors().where((F.col("vendor_active") == 1) & (F.col("vendor_deleted") == 0))
    return vendors.select(*VENDOR, "cuisine_id").join(F.broadcast(files), "cuisine_id", "left").select(
        *VENDOR, F.coalesce("banner", F.lit(f"{DEFAULT_CUISINE}_banner.jpg")).alias("banner"))


def prep_time(t) -> DataFrame:
    """Mean configured preparation time; without one the pickup time, raised to 10 when below 5."""
    settings = t.deliveries().groupBy(*VENDOR).agg(
        ratio(F.sum("prep_setting"), F.count("prep_setting")).alias("configured"))
    pickup = F.when(F.col("pickup_time") < 5, 10).otherwise(F.col("pickup_time")).cast("double")
    return t.vendors().select(*VENDOR, "pickup_time").join(settings, VENDOR, "left").select(
        *VENDOR, F.coalesce("configured", pickup).alias("prep_time_avg"))


def prep_benchmark(c: Column) -> Column:
    return F.when((c < 15) & (c >= 12), c - 2).when(c < 12, F.lit(10.0)).otherwise(F.lit(15.0))


def contacts(t) -> DataFrame:
    """One newsletter contact per vendor code, the smallest contact id."""
    rows = t.newsletter_contacts().where(F.col("excluded") == 0).drop("excluded")
    first = dedupe_first(rows, ["vendor_code"], ["contact_id"])
    return first.select("vendor_code", "email", concat_strict(F.col("vendor_code"), F.lit("_1")).alias("contact_key"))


def sendout(t, period, offline_start, dish_period, excluded: list[str]) -> DataFrame:
    """One row per live vendor that sold something, reachable or not: the base of the benchmark."""
    weeks = [f"_w_{w}" for w in range(1, 5)]
    vendors = t.vendors().where((F.col("vendor_active") == 1) & (F.col("vendor_deleted") == 0)).select(
        *VENDOR, "vendor_code", "vendor_name", "city_id", "backend_email")
    wide = join_all(
        vendors.join(vendor_weeks(t, period), VENDOR),
        [prep_time(t), banner(t), top_dishes(t, dish_period, excluded)], VENDOR,
    ).join(t.cities().select("tenant_id", "city_id", "city_name"), ["tenant_id", "city_id"], "left") \
        .join(t.countries().select("tenant_id", "country_name", "country_iso"), "tenant_id", "left") \
        .join(contacts(t), "vendor_code", "left") \
        .join(offline_hours(t, offline_start), VENDOR, "left")

    def part_of_tracked(c: Column) -> Column:
        tracked = F.col("tracked_orders")
        return F.when((tracked > 0) & (c > 0), round_half_away(ratio(c, tracked), 2).cast("double")).otherwise(F.lit(0.0))

    def plus(*names: str) -> list[Column]:
        shown = {2: "missing_wrong_items", 3: "cust_compl"}[len(names)]
        return [sum((F.col(n + s) for n in names[1:]), F.col(names[0] + s)).alias(shown + s) for s in ["", *weeks]]

    prep = F.when((F.col("valid_orders") <= 10) & (F.col("prep_time_avg") < 10), F.lit(10.0)).otherwise(
        round_half_away(F.col("prep_time_avg"), 0).cast("double"))
    counts = ["valid_orders", "vendor_late", "declined_orders", "damaged_packaging"]
    rows = wide.where(F.col("valid_orders") > 0).select(
        F.lit(period.label).alias("period"), *VENDOR, "vendor_code", "vendor_name", "city_name", "country_name",
        concat_strict(F.col("country_iso"), F.lit("_"), F.coalesce("contact_key", "vendor_code")).alias("subscriber_key"),
        F.coalesce("email", "backend_email").alias("email"), "banner",
        round_half_away(F.col("afv"), 0).cast("double").alias("afv"), "new_customers",
        prep.alias("prep_time_avg"), *[c + s for c in counts for s in ["", *weeks]],
        trunc_n(F.col("gmv_local"), 2).cast("double").alias("gmv_local"),
        round_half_away(ratio(F.col("vendor_late"), F.col("valid_orders")), 2).cast("double").alias("vendor_late_percentage"),
        *[f"{p}_{i}" for p in ("title", "quant") for i in range(1, 6)], "total_perc",
        F.coalesce("lost_gfv", F.lit(0.0)).alias("declined_gmv"), "overdue_orders",
        *plus("wrong_items", "missing_items"), *plus("wrong_items", "missing_items", "damaged_packaging"),
        part_of_tracked(F.col("wrong_items") + F.col("missing_items")).alias("missing_wrong_percentage"),
        part_of_tracked(F.col("damaged_packaging")).alias("damaged_packaging_percentage"),
        part_of_tracked(F.col("declined_orders")).alias("cancel_order_perc"),
        *[F.coalesce("offline_hours" + s, F.lit(0)).alias("offline_hours" + s) for s in ["", *weeks]],
    )
    return rows.withColumn("prep_time_benchmark", prep_benchmark(F.col("prep_time_avg")))


def newsletter(t, period, offline_start, dish_period, excluded: list[str]) -> DataFrame:
    """The rows of vendors that can be reached."""
    rows = sendout(t, period, offline_start, dish_period, excluded)
    return rows.where(F.col("email").isNotNull() & F.col("banner").isNotNull())


CITY = ["tenant_id", "period", "city_name"]


def city_benchmark(rows: DataFrame, seed: int = 0, large_max: int = 250, large_min: int = 75,
                   small_share: float = 0.3) -> DataFrame:
    """Mean figures of the best vendors of each city, damped where they would discourage.

    Best means more orders than ``large_min`` where the city's largest vendor passes ``large_max``,
    else more than ``small_share`` of that vendor. Random damping draws from a hash of the city.
    """
    sized = with_group(rows, CITY, {"max_orders": F.max("valid_orders")})
    best = sized.where(F.col("valid_orders") > F.when(
        F.col("max_orders") > large_max, F.lit(float(large_min))).otherwise(F.col("max_orders") * small_share))

    def mean(name: str, digits: int = 0) -> Column:
        return round_half_away(ratio(F.sum(name), F.count(F.lit(1))), digits).cast("double")

    means = best.groupBy(*CITY).agg(
        F.count(F.lit(1)).alias("bench_vendors"), mean("valid_orders").alias("orders"),
        mean("declined_orders").alias("declined"), mean("declined_gmv", 1).alias("declined_gmv"),
        F.coalesce(round_half_away(ratio(F.sum("declined_gmv"), F.sum("declined_orders")), 1).cast("double"), F.lit(0.0))
        .alias("declined_gmv_per_order"),
        mean("vendor_late").alias("late"), mean("overdue_orders").alias("overdue"),
        mean("damaged_packaging").alias("damaged"), mean("missing_wrong_items").alias("missing_wrong"),
        mean("offline_hours", 1).alias("offline"))
    key = F.concat_ws("|", *CITY)

    def draw(low: float, high: float, salt: int, digits: int) -> Column:
        return round_half_away(noise(key, low, high, seed + salt), digits).cast("double")

    def halved(name: str) -> Column:
        c = F.col(name)
        return F.when(c > 6, F.lit(3.0)).when(c > 3, round_half_away(c * 0.5, 0).cast("double")).otherwise(c)

    def share_of_orders(name: str) -> Column:
        c = F.col(name)
        return F.when((F.col("orders") > 0) & (c > 0), round_half_away(ratio(c, F.col("orders")), 2).cast("double")).otherwise(F.lit(0.0))

    orders, declined = F.col("orders"), F.col("declined")
    delay_share = noise(key, 8, 11, seed + 1) / 100
    return means.select(
        *CITY, "bench_vendors",
        F.when(orders < 10, orders * 4).when(orders < 20, orders * 2).otherwise(orders).alias("benchmark_valid_orders"),
        halved("declined").alias("benchmark_cancellation_num"),
        F.when(declined > 6, F.col("declined_gmv_per_order") * 3).when(declined > 3, F.col("declined_gmv") * 0.5)
        .otherwise(F.col("declined_gmv")).alias("benchmark_cancellations_gmv"),
        F.when(ratio(F.col("late"), orders) > 0.1, round_half_away(orders * delay_share, 0).cast("double"))
        .otherwise(F.col("late")).alias("benchmark_delay_num"),
        F.when(F.col("damaged") > 2, draw(1, 3, 2, 0)).otherwise(F.col("damaged")).alias("benchmark_packaging_num"),
        F.when(F.col("missing_wrong") > 3, draw(2, 4, 3, 0)).otherwise(F.col("missing_wrong")).alias("benchmark_missing_wrong_num"),
        F.when(F.col("offline") > 3, draw(1, 3, 4, 1)).otherwise(F.col("offline")).alias("benchmark_offline_num"),
        halved("overdue").alias("benchmark_overdue_num"),
        share_of_orders("missing_wrong").alias("benchmark_missing_wrong_perc"),
        share_of_orders("damaged").alias("benchmark_packaging_perc"),
        share_of_orders("declined").alias("benchmark_cancellation_perc"))


def improve_class(rows: DataFrame) -> DataFrame:
    """The issue to work on, 1 to 7: the first whose fivefold weight exceeds all others together.

    NULL in any term lets a rule fall through, down to 7 (nothing to say).
    """
    terms = {
        "canc": ratio(F.col("declined_orders"), F.col("valid_orders")) * 100,
        "delay": F.col("vendor_late_percentage") * 100,
        "missing": F.col("missing_wrong_percentage") * 100,
        "pack": F.col("damaged_packaging_percentage") * 100,
        "off": F.col("offline_hours") / 150.0 * 100,
        "prep": (F.greatest("prep_time_avg", F.lit(15.0)) - 15) / 300 * 100,
    }
    # rounding keeps binary noise away from the exact comparisons
    rows = rows.withColumns({f"_{name}": measure(c, 6) for name, c in terms.items()})

    def dominant(name: str) -> Column:
        rest = None
        for other in terms:
            if other != name:
                rest = F.col(f"_{other}") if rest is None else rest + F.col(f"_{other}")
        return measure(F.col(f"_{name}") * 5, 6) >= measure(rest, 6)

    number = (
        F.when(dominant("canc") & (F.col("_canc") > 0), 1)
        .when(dominant("delay") & (F.col("vendor_late_percentage") > 0.03), 2)
        .when(dominant("missing") & (F.col("_missing") > 0), 3)
        .when(dominant("pack") & (F.col("_pack") > 0), 4)
        .when(dominant("off") & (F.col("_off") > 0), 5)
        .when((F.col("_prep") > 0) & ((F.col("_pack") + F.col("_missing") + F.col("_canc") + F.col("_off")) > 0), 6)
        .otherwise(7))
    return rows.withColumn("improve_opportunity_num", number).drop(*[f"_{name}" for name in terms])


def with_benchmark(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """The sent row with benchmark and advice; who beats the city in both gets no advice on them."""
    joined = improve_class(rows).join(bench, CITY, "left")
    better = ((F.col("declined_orders") < F.col("benchmark_cancellation_num"))
              & (F.col("vendor_late") < F.col("benchmark_delay_num")) & F.col("improve_opportunity_num").isin(1, 2))
    few = F.col("benchmark_cancellation_num") < 1
    return joined.withColumns({
        "benchmark_cancellations_gmv": F.when(few, F.lit(0.0)).otherwise(F.col("benchmark_cancellations_gmv")),
        "improve_opportunity_num": F.when(better, 7).otherwise(F.col("improve_opportunity_num")),
    })
