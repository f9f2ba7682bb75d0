"""Edge values of the expressions and periods."""

from datetime import date, datetime

from pyspark.sql import functions as F

from partner_analytics import functions as X
from partner_analytics import periods

C = F.col


def column(spark, schema, values, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


def test_ratio_and_clamp(spark):
    assert column(spark, "a int, b int", [(1, 4), (1, 0), (None, 2), (3, None)], X.ratio(C("a"), C("b"))) == [0.25, None, None, None]
    assert column(spark, "a int", [-3, 0, 5, None], X.clamp0(C("a"))) == [0, 0, 5, None]


def test_rounding(spark):
    values = [0.5, 1.5, 2.5, -0.5, 2.675, None]
    assert column(spark, "a double", values, X.nearest_int(C("a"))) == [0, 2, 2, 0, 3, None]
    assert [float(v) if v is not None else None for v in column(spark, "a double", values, X.round_half_away(C("a"), 0))] == [
        1.0, 2.0, 3.0, -1.0, 3.0, None]
    assert float(column(spark, "a double", [2.675], X.round_half_away(C("a"), 2))[0]) == 2.68
    assert [float(v) for v in column(spark, "a double", [1.29, -1.29, 12.3], X.trunc_n(C("a"), 1))] == [1.2, -1.2, 12.3]


def test_quadratic_score(spark):
    assert column(spark, "a double", [9.0, 10.0, 25.0, None], X.quadratic_score(C("a"), 10)) == [0.0, 0.0, 225.0, None]
    assert round(column(spark, "a double", [5.6], X.quadratic_score(C("a"), 0.6))[0], 9) == 25.0


def test_noise_is_repeatable_and_in_range(spark):
    first = column(spark, "a int", list(range(50)), X.noise(C("a"), 8, 11, 3))
    assert first == column(spark, "a int", list(range(50)), X.noise(C("a"), 8, 11, 3))
    assert all(8 <= v < 11 for v in first) and len(set(first)) == 50


def test_text(spark):
    pair = [("a", "b"), ("a", None)]
    assert column(spark, "x string, y string", pair, X.concat_strict(C("x"), C("y"))) == ["ab", None]
    assert column(spark, "x string, y string", pair, X.concat_skip(C("x"), C("y"))) == ["ab", "a"]
    assert column(spark, "x string", ["Partner - OM Backlink", "none"], X.part(C("x"), " - ", 2)) == ["OM Backlink", ""]
    assert column(spark, "x string", ["001240000012345AAQ"], X.id15(C("x"))) == ["001240000012345"]
    assert column(spark, "x string", [None, "", " 123 ", "12345678"], X.bad_phone(C("x"))) == [True, True, True, False]
    assert column(spark, "x string", ["a.b;c", None], X.to_array(C("x"), ";")) == [["a.b", "c"], None]
    assert column(spark, "x string", ["Dean & David &", "Dean & David & Co"], X.like_any(C("x"), ["Dean & David &"])) == [True, False]
    assert column(spark, "x double", [0.256, 0.125, None], X.pct_text(C("x"))) == ["26%", "12%", None]
    assert column(spark, "x double", [2.6, 0.256, -0.5, None], X.growth_text(C("x"))) == ["3 times", "26 %", "-50 %", None]


def test_array_overlap(spark):
    arrays = [[1, 51], [], [None, 2], [None, 53], None]
    assert column(spark, "x array<int>", arrays, X.overlaps(C("x"), [51, 53])) == [True, False, False, True, None]


def test_flags(spark):
    assert column(spark, "x int", [1, 0, None], X.not_enabled(C("x"))) == [False, True, True]
    assert column(spark, "x boolean", [True, False, None], X.is_false(C("x"))) == [False, True, False]


def test_half_hour(spark):
    stamps = [datetime(2024, 1, 1, 9, m) for m in (14, 15, 16, 44, 45, 59)]
    assert column(spark, "x timestamp_ntz", stamps, X.half_hour(C("x"))) == [9.0, 9.0, 9.5, 9.5, 10.0, 10.0]


def test_iso_keys_at_year_edges(spark):
    days = [date(2017, 1, 1), date(2018, 12, 31), date(2020, 12, 31)]
    assert column(spark, "x date", days, X.iso_week_key(C("x"))) == ["2016-52", "2019-01", "2020-53"]
    assert column(spark, "x date", days, X.iso_month_key(C("x"))) == ["2016-01", "2019-12", "2020-12"]
    assert column(spark, "x date", days, X.week_key(C("x"), "year-week")) == ["2017-52", "2018-01", "2020-53"]
    assert column(spark, "x date", days, X.week_key(C("x"), "iso-sevenday")) == ["2016-01", "2019-53", "2020-53"]


def test_time_zone_and_closing(spark):
    stamps = [datetime(2024, 1, 15, 12), datetime(2024, 7, 15, 12)]
    shifted = X.shift_zone(C("x"), "Australia/Brisbane", "Australia/Sydney")
    assert column(spark, "x timestamp_ntz", stamps, shifted) == [datetime(2024, 1, 15, 13), datetime(2024, 7, 15, 12)]
    assert column(spark, "x int", [0, 3600, None], X.close_second(C("x"))) == [86340, 3600, None]


def test_month_arithmetic(spark):
    assert column(spark, "x date", [date(2001, 3, 31)], X.shift(C("x"), -1, "month")) == [date(2001, 2, 28)]
    assert periods.minus_months(date(2001, 3, 31), 1) == date(2001, 2, 28)


def test_periods():
    month = periods.period(date(2001, 7, 16), "month")
    assert (month.start, month.end, month.label) == (date(2001, 6, 1), date(2001, 6, 30), "2001-06")
    assert periods.period(date(2001, 1, 5), "month").start == date(2000, 12, 1)
    week = periods.period(date(2001, 7, 16), "week")
    assert (week.start, week.end, week.label) == (date(2001, 7, 9), date(2001, 7, 15), "2001-28")
    eight = periods.period(date(2001, 7, 18), "weeks", 8)
    assert (eight.start, eight.end, eight.days) == (date(2001, 5, 21), date(2001, 7, 15), 56)


def test_regression_of_few_points(spark):
    rows = spark.createDataFrame(
        [("none", 1.0, 50.0), ("one", 2.0, 1.0), ("flat", 1.0, 2.0), ("flat", 3.0, 2.0), ("line", 1.0, 1.0), ("line", 3.0, 2.0)],
        "k string, y double, x double")
    fit = rows.groupBy("k").agg(
        X.regr("intercept", C("y"), C("x"), C("x") < 10).alias("a"), X.regr("slope", C("y"), C("x"), C("x") < 10).alias("b"))
    got = {r.k: (r.a, r.b) for r in fit.collect()}
    assert got == {"none": (None, None), "one": (None, None), "flat": (None, None), "line": (-1.0, 2.0)}
