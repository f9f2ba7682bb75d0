"""Rules of the reports on hand-made rows: NULLs, boundaries, fan-out."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from partner_analytics import periods
from partner_analytics.operators import aggregates, filters, joins, sets
from partner_analytics.plans import audit, newsletter, queue, ramp
from partner_analytics.plans.opportunities import COMMISSION, FB_RIGHTS, MATERIAL, text
from partner_analytics.sources.crm import crm, labels

C = F.col
JUNE = periods.fixed(date(2001, 6, 1), date(2001, 6, 30))


class Tables:
    """A warehouse made of given frames."""

    def __init__(self, spark, **frames):
        self.spark = spark
        for name, frame in frames.items():
            setattr(self, name, lambda *args, frame=frame: frame)


def test_case_predicate_drops_rows_without_rule(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, v int")
    kept = filters.where_case(rows, [(C("k") == "a", C("v") == 1), (C("k") == "b", C("v") == 2)])
    assert [r.k for r in kept.collect()] == ["a"]


def test_lists_drop_nulls_on_both_sides(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r.k for r in filters.where_in(rows, "k", [1]).collect()] == [1]
    assert [r.k for r in filters.where_in(rows, "k", [1], keep=False).collect()] == [2]


def test_day_without_facts_gives_an_empty_row(spark):
    period = periods.fixed(date(2001, 6, 1), date(2001, 6, 3))
    facts = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2001-06-02 10:00:00'), (2, timestamp_ntz'2001-07-01 00:00:00') AS t(id, ts)")
    got = joins.on_day(joins.calendar(spark, period), facts, "ts", period).collect()
    assert sorted((r.day.day, r.id) for r in got if r.id is not None) == [(2, 1)]
    assert sorted(r.day.day for r in got if r.id is None) == [1, 3]


def test_bucket_rows_multiply_unless_all_keys_are_given(spark):
    facts = spark.createDataFrame([(1, 10, 1)], "tenant int, city int, weekday int")
    buckets = spark.createDataFrame([(1, 10, 1, "x"), (1, 11, 1, "y")], "tenant int, city int, weekday int, bucket string")
    assert joins.bucket_lookup(facts.drop("city"), buckets, ["tenant", "weekday"]).count() == 2
    assert joins.bucket_lookup(facts, buckets, ["tenant", "city", "weekday"]).count() == 1


def test_first_source_wins(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first = spark.createDataFrame([(1, "a")], "k int, v string")
    second = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    got = joins.resolve(base, first, second, ["k"], ["v"]).orderBy("k").collect()
    assert [r.v for r in got] == ["a", "b", None]


def test_cohort_bounds(spark):
    """Day 0 is no return, day ``n`` is, day ``n`` + 1 is not; other groups do not count."""
    start = date(2001, 6, 1)
    rows = [("v", c, start + timedelta(days=d)) for c, days in {
        "same": [0, 0], "last": [0, 28], "late": [0, 29], "twice": [0, 5, 9]}.items() for d in days]
    rows += [("w", "same", start + timedelta(days=3)), ("v", "young", date(2001, 6, 30)), ("v", "young", date(2001, 7, 1))]
    frame = spark.createDataFrame(rows, "vendor string, customer string, day date")
    got = {r.vendor: (r.base_customers, r.repeat_customers) for r in joins.cohort_repeat(
        frame, ["vendor"], "customer", "day", JUNE, date(2001, 7, 20), 28).collect()}
    assert got == {"v": (4, 2), "w": (1, 0)}


def test_chain_flags_spread(spark):
    rows = spark.createDataFrame(
        [(1, "c", "v1", 1), (1, "c", "v2", 0), (1, None, "v3", 0), (2, "c", "v4", 0)], "tenant int, chain string, vendor string, hit int")
    got = aggregates.rollup_max(rows.fillna("-"), ["vendor"], ["tenant", "chain"], ["hit"])
    assert {r.vendor: r.hit for r in got.collect()} == {"v1": 1, "v2": 1, "v3": 0, "v4": 0}


def test_unpivot_keeps_only_matching_specs(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, v int")
    specs = [{"kind": F.lit("all"), "x": C("v")}, {"kind": F.lit("big"), "x": C("v") * 2}]
    got = sets.unpivot(rows, ["id"], specs, [F.lit(True), C("v") > 10]).collect()
    assert sorted((r.id, r.kind, r.x) for r in got if r.x is not None) == [(1, "all", 5), (2, "all", 50), (2, "big", 100)]
    assert len(got) == 4


def test_crm_labels_round_trip(spark):
    extract = spark.createDataFrame([("1", "x")], "`18 Char Account ID` string, `Account.Name` string")
    mapping = {"18 Char Account ID": "account_id"}
    assert crm(extract, mapping).columns == ["account_id"]
    assert labels(crm(extract, mapping), mapping).columns == ["18 Char Account ID"]


def test_null_slot_makes_text_null(spark):
    rows = spark.createDataFrame([("a",), (None,)], "v string")
    got = [r.out for r in rows.select(text("Value {value}%.", value=C("v")).alias("out")).collect()]
    assert got == ["Value a%.", None]


def test_vat_rules(spark):
    rows = spark.createDataFrame(
        [(0, None, 0, 1, "A"), (1, None, 1, 1, "A"), (2, 1, 0, 9, "A"), (3, 0, 0, 9, "A"), (4, None, 1, 1, "B"), (5, 0, 1, 1, "B"), (6, 0, 0, 1, "B")],
        "i int, vat int, deleted int, tenant int, brand string")
    got = rows.select("i", audit.vat_flag(C("vat"), C("deleted"), C("tenant"), C("brand"), [9]).alias("f")).orderBy("i")
    assert [r.f for r in got.collect()] == [1, 0, 1, 0, 1, 0, 1]


def audit_tables(spark, scheduled):
    base = ("SELECT {i} AS vendor_id, {tenant} AS tenant_id, 'v{i}' AS vendor_code, 'Shop' AS vendor_name, 1 AS city_id, 'A' AS brand, 1 AS vendor_active,"
            " 0 AS vendor_deleted, 0 AS vendor_testing, 0 AS accept_voucher, 1 AS accept_discount, 1 AS accept_delivery, 1 AS online_payment,"
            " 1 AS automatic_calls_enabled, 1 AS vat_included, 1 AS automatic_calls_delay, '0049 12345678' AS phone, 1 AS active_menus,"
            " 'Active' AS account_status")
    vendors = spark.sql(" UNION ALL ".join(base.format(i=i, tenant=tenant) for i, tenant in [(1, 1), (2, 1), (3, 2)]))
    return Tables(
        spark, vendors=vendors,
        countries=spark.sql("SELECT * FROM VALUES (1, 'One', 1, true), (2, 'Two', 1, false) AS t(tenant_id, country_name, live, managed)"),
        cities=spark.sql("SELECT * FROM VALUES (1, 1, 'Town', 1), (2, 1, 'Port', 1) AS t(tenant_id, city_id, city_name, city_active)"),
        schedules=spark.sql("SELECT * FROM VALUES " + ", ".join(f"(1, {v}, 1, 0, 0)" for v in scheduled) + " AS t(tenant_id, vendor_id, weekday, start_s, stop_s)"),
        vendor_orders=spark.sql("SELECT 1 AS tenant_id, 9 AS vendor_id, 1L AS order_id, 'F' AS status_id, timestamp_ntz'2001-06-01 00:00:00' AS order_ts"),
        order_status=spark.sql("SELECT 'F' AS status_id, 1 AS valid_order"))


def test_missing_flag_hides_the_vendor(spark):
    """Vendor 2 has no schedule and vendor 3 no managed country: their flag sums are NULL."""
    got = audit.backend_audit(audit_tables(spark, [1, 3]), date(2001, 7, 16), []).collect()
    assert [(r.vendor_id, r.no_voucher, r.weird_opening_hours) for r in got] == [(1, 1, 0)]


def test_midnight_closing_counts_as_open_day(spark):
    got = audit.short_days(audit_tables(spark, [1])).collect()
    assert [(r.vendor_id, r.short_day) for r in got] == [(1, 0)]


def queue_rows(spark, open_types):
    rows = spark.createDataFrame(
        [(1, "o", i, f"v{i}", f"n{i}", COMMISSION, 3, "commission", "20%", "text", float(1000 - i), i) for i in range(1, 9)]
        + [(1, "o", 1, "v1", "n1", FB_RIGHTS, 5, "FB", "0", "text", 900.0, 20),
           (1, "o", 3, "v3", "n3", MATERIAL, 0, "display", "0", "text", 800.0, 21), (1, "o", 3, "v3", "n3", MATERIAL, 0, "Door stickers", "0", "text", 800.0, 22)],
        "tenant_id int, owner string, vendor_id int, vendor_code string, vendor_name string, opportunity string, score int, kpi string,"
        " kpi_value string, description string, value double, rank int")
    opened = spark.createDataFrame([("o", k, n, 1.0) for k, n in open_types], "owner string, record_type string, open_per_type int, opportunity_points double")
    return queue.queue(rows, opened)


def test_caps_need_an_open_count(spark):
    """Without an open item of the type the commission cap and the FB override never fire."""
    free = {(r.opportunity, r.vendor_id): r["rank"] for r in queue_rows(spark, [(MATERIAL, 1)]).collect()}
    assert len([k for k in free if k[0] == COMMISSION]) == 8 and free[(FB_RIGHTS, 1)] == 20
    capped = {(r.opportunity, r.vendor_id): r["rank"] for r in queue_rows(spark, [(COMMISSION, 1), (FB_RIGHTS, 1)]).collect()}
    assert len([k for k in capped if k[0] == COMMISSION]) == 4 and capped[(FB_RIGHTS, 1)] == 1


def test_tied_material_items_are_both_cut(spark):
    got = queue_rows(spark, [(COMMISSION, 1)]).collect()
    assert not [r for r in got if r.opportunity == MATERIAL]


def test_cleaned_delay(spark):
    rows = spark.createDataFrame(
        [(0, -1, 6.0, False), (1, 0, 6.0, False), (2, 10, 16.0, False), (3, 11, 16.0, False), (4, -1, 6.0, True), (5, None, 6.0, False)],
        "i int, late int, pickup double, again boolean")
    got = rows.select("i", newsletter.cleaned_delay(C("late"), C("pickup"), C("again")).alias("d")).orderBy("i")
    assert [r.d for r in got.collect()] == [6.0, 6.0, 6.0, None, None, None]


def test_improvement_class(spark):
    columns = "i int, declined_orders int, valid_orders int, vendor_late_percentage double, missing_wrong_percentage double, damaged_packaging_percentage double, offline_hours int, prep_time_avg double"
    rows = spark.createDataFrame(
        [(1, 5, 100, 0.0, 0.0, 0.0, 0, 10.0), (2, 0, 100, 0.2, 0.0, 0.0, 0, 10.0), (3, 0, 100, 0.0, 0.1, 0.0, 0, 10.0),
         (4, 0, 100, 0.0, 0.0, 0.1, 0, 10.0), (5, 0, 100, 0.0, 0.0, 0.0, 9, 10.0), (7, 0, 100, 0.0, 0.0, 0.0, 0, 10.0), (7, 5, 100, None, None, None, None, None)], columns)
    assert all(r.i == r.improve_opportunity_num for r in newsletter.improve_class(rows).collect())


def test_prep_benchmark(spark):
    rows = spark.createDataFrame([(11.0,), (12.0,), (14.5,), (15.0,), (None,)], "v double")
    assert [r.b for r in rows.select(newsletter.prep_benchmark(C("v")).alias("b")).collect()] == [10.0, 10.0, 12.5, 15.0, 15.0]


def test_ramp_spans_include_both_ends(spark):
    born = date(2001, 1, 1)
    offsets = [0, 30, 31, 180, 181, 365, 366]
    orders = spark.createDataFrame([(1, 1, i, "F", born + timedelta(days=d)) for i, d in enumerate(offsets)],
                                   "tenant_id int, vendor_id int, order_id int, status_id string, order_ts date")
    tables = Tables(
        spark, vendor_orders=orders, order_status=spark.sql("SELECT 'F' AS status_id, 1 AS valid_order"),
        countries=spark.sql("SELECT 1 AS tenant_id, 'One' AS country_name"),
        vendors=spark.sql("SELECT * FROM VALUES (1, 1, 'v1', 'n', 1, date'2001-01-01'), (1, 2, 'v2', 'n', 1, date'2001-01-01')"
                          " AS t(tenant_id, vendor_id, vendor_code, vendor_name, vendor_active, activation_date)"))
    got = {r.vendor_id: r for r in ramp.ramp(tables, date(2002, 6, 1), start_order=3).collect()}
    first = got[1]
    assert (first.orders_first_month, first.orders_first_3_month, first.orders_first_6_month, first.orders_first_year) == (2, 3, 4, 6)
    assert first.orders_after_start == 3 and (first.flag_6_month, first.flag_year) == (1, 1)
    assert got[2].orders_first_month is None and got[2].flag_6_month is None
