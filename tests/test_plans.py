"""Physical plans: pruning, pushdown, no all-pairs joins, no single-task windows, few shuffles."""

import re
from datetime import date

import pytest

from partner_analytics.catalog import load
from partner_analytics.sources.tables import Warehouse

SF_DIR = "/root/testdata/sf0.001"
LAZY = """rpt_order_kpis rpt_reorder_rate rpt_complaint_rate rpt_packaging_nps rpt_marketing_attrs rpt_ops_meta rpt_newsletter
rpt_city_benchmark rpt_delay_attribution rpt_backend_audit rpt_stock_decision rpt_deal_uplift rpt_vendor_ramp rpt_top_dishes
rpt_pursuability_flags rpt_open_opportunities join_cross_spine join_date_spine agg_count_distinct_filter win_top_n""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_plan_shape(spark, key):
    text = plan(load()[key](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "Python", "Pandas"):
        assert word not in text, f"{word} in the plan of {key}"


def test_dates_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(load()["rpt_order_kpis"](spark, SF_DIR))
    orders = next(line for line in text.splitlines() if "FileScan" in line and "o_orderdate" in line)
    assert re.search(r"GreaterThanOrEqual\(o_orderdate,2001-06-01", orders)
    assert re.search(r"LessThan(OrEqual)?\(o_orderdate,2001-0[67]", orders)
    assert "o_totalprice" not in orders and "o_comment" not in orders
    lines = next(line for line in text.splitlines() if "FileScan" in line and "l_extendedprice" in line)
    assert "l_shipdate" not in lines and "l_returnflag" not in lines


def test_order_fact_shuffles_lines_once(spark):
    """With tables too large to broadcast, lines and orders meet by order and stay there."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Warehouse(spark, SF_DIR).vendor_orders())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    by_order = [k for k in keys if k.startswith("order_id")]
    assert len(by_order) == 2 and all("vendor_id" not in k for k in by_order)


REDUCED = {"rpt_packaging_nps": "l_suppkey", "rpt_complaint_rate": "event_type", "rpt_order_issue_flags": "event_type", "rpt_marketing_attrs": "l_linestatus"}


@pytest.mark.parametrize("key,column", REDUCED.items())
def test_large_side_is_reduced_before_its_shuffle(spark, key, column):
    """Between the scan of lines, contacts or sales and the first exchange stands the join with the bitmap."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the bitmap carries its own hint
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        lines = plan(load()[key](spark, SF_DIR)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and column in line.split("Batched")[0]
             and not any(other in line.split("Batched")[0] for other in ("l_extendedprice", "submitted"))]
    assert scans
    for at in scans:
        depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
        for line in lines[at::-1]:  # the operators over the scan, from the nearest on
            here = len(line) - len(line.lstrip(" :+-"))
            if here <= depth and line is not lines[at]:
                above.append(line)
                depth = here
            if "Exchange hashpartitioning" in line and here <= depth:
                break
        names = [re.sub(r"^[ :+\-*()\d]*", "", line).split(" ")[0] for line in above]
        assert "BroadcastHashJoin" in names and names.index("BroadcastHashJoin") < names.index("Exchange"), names


def test_small_dimensions_do_not_shuffle_the_fact(spark):
    text = plan(Warehouse(spark, SF_DIR).vendor_orders())
    assert "hashpartitioning(vendor_id" not in text


def test_final_sort_keeps_its_order(spark):
    rows = [tuple(r)[:3] for r in load()["sort_multi_key"](spark, SF_DIR).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1], -r[2]))


@pytest.mark.parametrize("key", ["rpt_final_metrics", "rpt_scorecard"])
def test_card_reads_the_orders_of_its_period_once(spark, key):
    """The stored sums stand in for the period: what is left reads no price and no order of the month."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(load()[key](spark, SF_DIR))
    assert "l_extendedprice" not in text and "o_orderdate,2001-06-01" not in text


def test_lines_of_a_period_are_cut_at_their_scan(spark):
    """Lines of other dates go before the shuffle, and none of the period's is lost."""
    start, end = date(2001, 6, 1), date(2001, 6, 30)
    tables = Warehouse(spark, SF_DIR)
    kept, of_period = tables.order_lines(start, end), tables.order_ids(start, end)
    exact = tables.order_lines().join(of_period, "order_id", "left_semi")
    assert 0 < exact.count() == kept.join(of_period, "order_id", "left_semi").count()
    assert 20 * kept.count() < tables.order_lines().count()
    for fact in (tables.vendor_orders(start, end), tables.order_products(start, end)):
        assert "xxhash64(l_orderkey" in plan(fact) or "xxhash64(order_id" in plan(fact)
