"""Score ladders at every threshold, just beside it, and for NULL."""

import pytest
from pyspark.sql import functions as F

from partner_analytics.functions import LADDERS, OPS_LADDERS, dish_score, facebook_score, ladder

EPS = 1e-9


def scores(spark, spec, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.s for r in rows.select("i", ladder(F.col("v"), spec).alias("s")).orderBy("i").collect()]


# value -> score, read off the published bands
EXPECTED = {
    "commission": {0.2199: 0, 0.22: 1, 0.225: 1, 0.23: 3, 0.2399: 3, 0.29: 9, 0.2999: 9, 0.30: 10, 0.5: 10, None: 0},
    "cr3": {0.0749: 0, 0.075: 1, 0.0999: 1, 0.25: 8, 0.275: 9, 0.2999: 9, 0.3: 10, None: 0},
    "price_mark_up": {0.0: 10, 0.5: 0, 1.0: 0, None: 0},
    "packaging_quality": {4.0: 0, 3.0: 3, 0.0: 5, 2.0: 8, 1.0: 10, 5.0: 0, None: 0},
    "facebook_likes": {999.0: 10, 1000.0: 9, 9999.0: 1, 10000.0: 0, None: None},
    "reorder_rate": {0.0: 0, 0.01: 1, 0.0899: 8, 0.09: 9, 0.1: 10, None: None},
    "menucategories": {8.0: 10, 9.0: 9, 10.0: 8, 11.0: 4, 12.0: 3, 13.0: 2, 14.0: 1, 15.0: 0, None: 0},
    "products": {40.0: 10, 41.0: 9, 46.0: 8, 50.0: 7, 51.0: 6, 60.0: 5, 61.0: 4, 70.0: 3, 75.0: 2, 76.0: 0, 78.0: 0,
                 80.0: 0, 81.0: 1, 85.0: 1, 86.0: 0, None: 0},
    "products_without_description": {0.05: 10, 0.0500001: 9, 0.10: 9, 0.50: 1, 0.51: 0, None: 0},
    "automation": {0.8199: 0, 0.82: 1, 0.97: 8, 0.98: 9, 0.99: 10, None: None},
    "cancellations": {0.0: 10, 0.005: 9, 0.01: 9, 0.0100001: 8, 0.09: 1, 0.0901: 0, -0.1: None, None: None},
    "processing_time": {1.0: 10, 1.2: 9, 1.5: 8, 1.8: 7, 2.0: 7, 2.1: 6, 2.5: 5, 2.9: 4, 3.2: 3, 3.5: 2, 4.0: 1, 4.1: 0, None: None},
    "revenue": {5.5: 0, 5.6: 1, 6.0: 2, 9.4: 8, 9.5: 9, 10.0: 10, None: 0},
    "customer_complaints": {0.0: 10, 0.01: 8, 0.02: 7, 0.03: 6, 0.04: 4, 0.05: 2, 0.06: 0, None: None},
    "closing_hours": {0.0: 10, 0.02: 9, 0.021: 8, 0.18: 1, 0.19: 0, None: None},
}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_bands(spark, name):
    assert set(EXPECTED) == set(LADDERS)
    values = list(EXPECTED[name])
    assert scores(spark, LADDERS[name], values) == [EXPECTED[name][v] for v in values]


@pytest.mark.parametrize("name", list(LADDERS))
def test_monotone_and_first_match(spark, name):
    """Evaluate each edge and its neighbours with a plain loop over the bands."""
    spec = LADDERS[name]
    edges = sorted({e for low, _, high, _, _ in spec.bands for e in (low, high) if e is not None})
    values = [v for e in edges for v in (e - EPS, float(e), e + EPS)] + [None]

    def by_hand(v):
        for low, low_closed, high, high_closed, score in spec.bands:
            if v is None:
                break
            above = low is None or v > low or (low_closed and v == low)
            below = high is None or v < high or (high_closed and v == high)
            if above and below:
                return score
        return spec.missing

    assert scores(spark, spec, values) == [by_hand(v) for v in values]


def test_ops_bands(spark):
    assert scores(spark, OPS_LADDERS["overall"], [0.0, 25.9, 26.0, 279.0, 280.0, 313.9, 314.0, 900.0, -1.0, None]) == [
        10, 10, 9, 2, 1, 1, 0, 0, None, None]
    assert scores(spark, OPS_LADDERS["waiting"], [1.9, 2.0, 24.9, 25.0]) == [10, 9, 1, 0]


def test_facebook_and_dish(spark):
    rows = spark.sql("""SELECT * FROM VALUES (0, 1, 1, 0, 3, 0, 0, 1), (1, 0, 1, 0, 3, 1, 0, null), (2, 0, 1, 1, 3, 1, 0, 2),
      (3, 0, 0, 0, 3, 0, 1, 3), (4, 0, 0, 0, null, 1, 1, 8) AS t(i, no_fb, top, rights, likes, city, country, stage)""")
    got = rows.select(
        "i", facebook_score(F.col("no_fb"), F.col("top"), F.col("rights"), F.col("likes")).alias("fb"),
        dish_score(F.col("city"), F.col("country"), F.col("stage")).alias("dish")).orderBy("i").collect()
    assert [r.fb for r in got] == [10, 0, 10, 3, 0]
    assert [r.dish for r in got] == [10, 0, 5, 7, 10]
