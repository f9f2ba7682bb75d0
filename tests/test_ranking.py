"""Ranks and running totals against brute force, over range slices."""

import random

import pytest
from pyspark.sql import functions as F

from partner_analytics.operators import ranking
from partner_analytics.operators.aggregates import distinct_counts, pivot_ranked, with_group
from partner_analytics.operators.ranking import asc, desc



@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key, many ties, some NULLs, one NULL key."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        value = None if i % 41 == 0 else rng.randint(0, 25)
        rows.append((i, key, value, i % 7 + 1))
    frame = spark.createDataFrame(rows, "id int, key string, value int, points int").repartition(5)
    return rows, frame


def ordered(rows, key):
    """Descending by value, NULL first, then by id."""
    mine = [r for r in rows if r[1] == key]
    return sorted(mine, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))


def keys_of(rows):
    return {r[1] for r in rows}


def test_row_number_and_running_sum(skewed):
    rows, frame = skewed
    out = ranking.running(frame, ["key"], [desc("value"), asc("id")], {"total": "points"})
    got = {r.id: (r.row_no, r.total) for r in out.collect()}
    assert len(got) == len(rows)
    for key in keys_of(rows):
        total = 0
        for n, r in enumerate(ordered(rows, key), 1):
            total += r[3]
            assert got[r[0]] == (n, total)


def test_rank_shares_places(skewed):
    rows, frame = skewed
    got = {r.id: r["rank"] for r in ranking.rank_in(frame, ["key"], "value").collect()}
    for key in keys_of(rows):
        mine = ordered(rows, key)
        for r in mine:
            first = next(i for i, other in enumerate(mine, 1) if other[2] == r[2])
            assert got[r[0]] == first


def test_global_rank(skewed):
    rows, frame = skewed
    got = {r.id: r.global_rank for r in ranking.global_rank(frame, "value").collect()}
    for r in rows:
        before = sum(1 for o in rows if r[2] is not None and (o[2] is None or o[2] > r[2]))
        assert got[r[0]] == before + 1


def test_running_count_includes_ties(skewed):
    rows, frame = skewed
    got = {r.id: r.running_count for r in ranking.running_count(frame, ["key"], "value").collect()}
    for r in rows:
        mine = [o for o in rows if o[1] == r[1]]
        upto = sum(1 for o in mine if o[2] is None or (r[2] is not None and o[2] >= r[2]))
        assert got[r[0]] == upto


def test_budget_is_a_prefix(skewed):
    rows, frame = skewed
    out = ranking.within_budget(frame.withColumn("budget", F.lit(200)), ["key"], "points", [desc("value")], "budget")
    kept = {r.id: r.running_total for r in out.collect()}
    assert kept and max(kept.values()) <= 200
    for key in keys_of(rows):
        mine = ordered(rows, key)
        for r in mine:
            total = sum(o[3] for o in mine if o[2] is None or (r[2] is not None and o[2] >= r[2]))
            assert (r[0] in kept) == (total <= 200)


@pytest.mark.parametrize("tiles,top", [(100, 10), (100, 35), (7, 3), (1000, 10)])
def test_top_ntile(skewed, tiles, top):
    rows, frame = skewed
    out = ranking.in_top_ntile(frame, ["key"], "value", ["id"], tiles, top, "top")
    got = {r.id: r.top for r in out.collect()}
    for key in keys_of(rows):
        mine = ordered(rows, key)
        size, extra = divmod(len(mine), tiles)
        tile_of = [tile for tile in range(1, tiles + 1) for _ in range(size + (tile <= extra))]
        for r, tile in zip(mine, tile_of):
            assert got[r[0]] == int(tile <= top)


def test_picks(skewed):
    rows, frame = skewed
    latest = {r.key: r.id for r in ranking.latest(frame, ["key"], ["points", "id"], ["id"]).collect()}
    first = {r.key: r.id for r in ranking.dedupe_first(frame, ["key"], ["id"]).collect()}
    for key in keys_of(rows):
        mine = [r for r in rows if r[1] == key]
        assert latest[key] == max(mine, key=lambda r: (r[3], r[0]))[0]
        assert first[key] == min(r[0] for r in mine)
    top = ranking.top_n(frame, ["key"], "value", ["id"], 5).collect()
    for key in keys_of(rows):
        assert [r.id for r in sorted((t for t in top if t.key == key), key=lambda t: t["rank"])] == [
            r[0] for r in ordered(rows, key)[:5]]


def test_top_n_is_cut_before_the_shuffle(skewed):
    plan = ranking.top_n(skewed[1], ["key"], "value", ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_groups_join_back(skewed):
    rows, frame = skewed
    got = with_group(frame, ["key"], {"n": F.count(F.lit(1)), "top": F.max("value")}).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [o for o in rows if o[1] == r.key]
        assert (r.n, r.top) == (len(mine), max(o[2] for o in mine if o[2] is not None))


def test_nth_event(spark):
    days = ["2001-01-01"] * 3 + ["2001-01-02"] * 21 + ["2001-01-05", "2001-01-09"]
    frame = spark.createDataFrame([("a", d) for d in days] + [("b", "2001-01-01")] * 24, "key string, d string")
    got = ranking.nth_event(frame.withColumn("ts", F.to_timestamp_ntz("d")), ["key"], "ts", 25).collect()
    assert [(r.key, str(r.nth_day)) for r in got] == [("a", "2001-01-05")]


def test_distinct_counts_and_missing_rank(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", None, "x")], "k string, id int, c string")
    got = distinct_counts(rows, ["k"], "id", {"x": F.col("c") == "x", "y": F.col("c") == "y"}).collect()[0]
    assert (got.x, got.y) == (1, 2)
    ranked = spark.createDataFrame([("v", 1, "soup"), ("v", 2, "rice")], "k string, rank int, title string")
    wide = pivot_ranked(ranked, ["k"], "rank", {"title": "t"}, 3).collect()[0]
    assert (wide.t_1, wide.t_2, wide.t_3) == ("soup", "rice", "")
