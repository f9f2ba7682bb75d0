"""Orders, dispatch orders and trips as separate tables: statuses, orders without trips, two tenants with equal ids."""

from datetime import date, datetime

import pytest
from test_reports import Tables

from partner_analytics import periods
from partner_analytics.operators import joins
from partner_analytics.plans import delay, newsletter, ops

NOW = date(2024, 1, 31)
T = datetime(2024, 1, 30, 12, 20)
OLD = datetime(2023, 12, 1, 12, 0)


@pytest.fixture(scope="module")
def tables(spark):
    """Tenants 1 and 2 both have vendor 7 and orders 1 to 5; only tenant 1 has orders that a filter removes."""
    placed = [  # tenant, city, brand, order, vendor, order_ts, status, gfv, preorder, confirm_ts
        (1, 10, "A", 1, 7, T, "ok", 10.0, 0, T), (1, 10, "A", 2, 7, T, "bad", 20.0, 0, T), (1, 10, "A", 3, 7, T, "ok", 30.0, 1, T),
        (1, 10, "A", 4, 7, T, "ok", 40.0, 0, T), (1, 10, "A", 5, 7, T, "ok", 50.0, 0, T), (1, 10, "A", 6, 7, OLD, "ok", 60.0, 0, OLD),
        (2, 20, "B", 1, 7, T, "ok", 100.0, 0, T), (2, 20, "B", 8, 7, T, "ok", 5.0, 0, T)]
    dispatch = [  # tenant, dispatch, order, created, delivered, picked, status, platform, utilisation, prep, buffer, courier, vendor, pickup
        (1, 101, 1, T, T, T, "completed", "Ours", 10, 12, 1, -2, 9, 8.0), (1, 102, 2, T, T, T, "completed", "ours", 10, 12, 1, 0, 0, 1.0),
        (1, 103, 3, T, T, T, "completed", "ours", 10, 12, 1, 3, 0, 12.0), (1, 104, 4, T, T, T, "cancelled", "ours", 10, 12, 1, 0, 0, 1.0),
        (1, 105, 5, T, T, T, "completed", "other", 10, 12, None, 0, 0, 1.0), (1, 106, 6, OLD, OLD, OLD, "completed", "ours", 10, 12, 1, 0, 0, 1.0),
        (2, 101, 1, T, T, T, "completed", "ours", 10, 30, 1, 6, 6, 7.0)]
    trips = [  # tenant, trip, dispatch, ended, status, redelivery, at_door, offset
        (1, 1, 101, T, "completed", False, 5.0, 1), (1, 2, 101, T, "failed", True, 50.0, 9), (1, 3, 102, T, "completed", False, 6.0, 1),
        (1, 4, 103, T, "completed", False, 7.0, 1), (1, 5, 104, T, "failed", False, 8.0, 1), (1, 6, 105, T, "completed", False, 9.0, 1),
        (1, 7, 106, OLD, "completed", False, 9.0, 1), (2, 1, 101, T, "completed", True, 15.0, 2)]
    frame = spark.createDataFrame
    return Tables(
        spark,
        placed_orders=frame(placed, "tenant_id int, city_id int, brand string, order_id int, vendor_id int, order_ts timestamp_ntz, status_id string, gfv double, preorder int, confirm_ts timestamp_ntz"),
        dispatch_orders=frame(dispatch, "tenant_id int, dispatch_id int, order_id int, created_ts timestamp_ntz, delivered_ts timestamp_ntz, picked_ts timestamp_ntz, dispatch_status string, "
                              "platform string, utilisation int, prep_min int, prep_buffer int, courier_late_min int, vendor_late_min int, pickup_delay_min double"),
        courier_trips=frame(trips, "tenant_id int, trip_id int, dispatch_id int, ended_ts timestamp_ntz, trip_status string, redelivery boolean, at_door_min double, arrival_offset int"),
        order_status=frame([("ok", 1), ("bad", 0)], "status_id string, valid_order int"),
        vendors=frame([(1, 7, "one", "v1", "A", 1, 10), (2, 7, "two", "v2", "B", 1, 20)],
                      "tenant_id int, vendor_id int, vendor_name string, vendor_code string, brand string, vendor_active int, city_id int"),
        countries=frame([(1, "First land", "First"), (2, "Second land", "Second")], "tenant_id int, country_name string, company string"),
        cities=frame([(1, 10, "Ten"), (2, 20, "Twenty")], "tenant_id int, city_id int, city_name string"),
        prep_buckets=frame([(1, 2, 12.5, "lunch one"), (2, 2, 12.5, "lunch two")], "tenant_id int, weekday int, half_hour double, bucket string"))


def test_ops_orders_keep_what_the_status_allows(tables):
    got = {(r.tenant_id, r.order_id): r for r in ops.ops_orders(tables, NOW).collect()}
    # 2 isn't valid, 3 is a preorder, 5 has no buffer, 6 is old; 8 was never dispatched
    assert sorted(got) == [(1, 1), (1, 4), (2, 1)]
    assert got[1, 1].waiting_time == pytest.approx(2.6) and got[1, 1].redelivery == 0  # the failed trip doesn't count
    assert got[1, 4].waiting_time is None and got[1, 4].arrival_offset is None  # no completed trip, still an order
    assert got[2, 1].waiting_time == pytest.approx(12.6) and got[2, 1].prep_min == 30 and got[2, 1].city_id == 20


def test_ops_meta_counts_orders_of_its_tenant(tables):
    got = {r.tenant_id: r for r in ops.ops_meta(tables, NOW).collect()}
    assert (got[1].orders_evaluated, got[2].orders_evaluated) == (2, 1)
    assert (got[1].redelivery_rate, got[2].redelivery_rate) == (0.0, 100.0)


def test_clean_delay_counts_orders_without_trip(tables):
    got = {r.tenant_id: r for r in newsletter.clean_delay(tables, NOW).collect()}
    one, two = got[1], got[2]
    assert (one.valid_orders, one.delay_observations, one.late_over_5_min, one.late_over_10_min) == (4, 3, 2, 0)
    assert (two.valid_orders, two.delay_observations, two.late_over_5_min) == (2, 0, 0)  # redelivered, and never dispatched
    assert {r.tenant_id for r in newsletter.clean_delay(tables, NOW, tenants=[2]).collect()} == {2}


def test_delay_attribution_resolves_by_tenant(tables):
    period = periods.fixed(date(2024, 1, 29), date(2024, 1, 31))
    rows = delay.delay_attribution(tables, period, NOW, {"First": 4}, rate=2.0).collect()
    got = {(r.tenant_id, r.order_id): r for r in rows}
    assert sorted(k for k in got if k[0]) == [(1, 1), (1, 2), (1, 3), (2, 1)]  # 4 was cancelled, 5 went through others
    assert sorted(r.day.day for r in rows if r.tenant_id is None) == [29, 31]
    one, two = got[1, 1], got[2, 1]
    assert (one.vendor_name, one.gfv, one.hour_bucket, one.delay_vendor, one.delay_mix) == ("one", 10.0, "lunch one", 1, 0)
    assert (two.vendor_name, two.gfv, two.hour_bucket, two.delay_vendor, two.delay_mix) == ("two", 200.0, "lunch two", 0, 1)


def test_weeks_back_depend_on_the_company(tables):
    period = periods.fixed(date(2023, 11, 27), date(2024, 1, 31))
    far = delay.delay_attribution(tables, period, NOW, {"First": 10}).where("tenant_id = 1").collect()
    near = delay.delay_attribution(tables, period, NOW, {"First": 4}).where("tenant_id = 1").collect()
    assert {r.order_id for r in far} - {r.order_id for r in near} == {6}


def test_first_source_with_a_value_wins(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 5, None)], "k int, x int, y string")
    second = spark.createDataFrame([(1, 9, "b"), (2, 6, "c")], "k int, x int, y string")
    got = joins.resolve_by_priority(rows, [first, second], ["k"], ["x", "y"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 9, "a"), (2, 5, "c"), (3, None, None)]


def test_reducer_keeps_all_partners(spark):
    large = spark.sql("SELECT IF(id % 7 = 0, NULL, id) AS k, id AS v, 1 AS _x FROM range(20000)")
    small = spark.sql("SELECT CAST(id * 31 AS INT) AS k FROM range(400) UNION ALL SELECT NULL")
    got = joins.reduced(large, small, ["k"])
    assert got.columns == large.columns
    keys = {r.k for r in got.collect()}
    want = {k for k in range(0, 12400, 31) if k % 7}
    assert want <= keys and len(keys) < len(want) + 20 and None not in keys
    assert joins.reduced(large, small.where("false"), ["k"]).count() == 0
