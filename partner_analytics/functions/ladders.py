"""Score ladders: threshold bands mapped to 0..10, first matching band wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Ladder", "LADDERS", "OPS_LADDERS", "BINARY", "ladder", "facebook_score", "dish_score"]


@dataclass(frozen=True)
class Ladder:
    """``bands`` holds (low, low_closed, high, high_closed, score); None is unbounded.

    ``missing`` is the score of NULL and of values no band covers.
    """

    bands: tuple
    missing: float | None = None


def rising(starts, scores, missing=None) -> Ladder:
    """Bands [start, next start); the first band has no lower bound."""
    edges = list(starts) + [None]
    bands = [(None, False, edges[0], False, scores[0])]
    bands += [(edges[i], True, edges[i + 1], False, scores[i + 1]) for i in range(len(starts))]
    return Ladder(tuple(bands), missing)


def ceiling(tops, scores, missing=None) -> Ladder:
    """Bands (previous top, top]; the last score covers everything above."""
    bands, low = [], None
    for top, score in zip(tops, scores):
        bands.append((low, False, top, True, score))
        low = top
    bands.append((low, False, None, False, scores[-1]))
    return Ladder(tuple(bands), missing)


def exactly(values: dict, missing=None) -> Ladder:
    return Ladder(tuple((v, True, v, True, s) for v, s in values.items()), missing)


def zero_then(tops, scores) -> Ladder:
    """0 scores 10, then (previous top, top]; below zero there is no band."""
    rest = ceiling(tops, scores).bands
    first = (0, False) + rest[0][2:]
    return Ladder(((0, True, 0, True, 10), first) + rest[1:])


def ladder(c: Column, spec: Ladder) -> Column:
    """Evaluate the bands in order, as one CASE."""
    out = None
    for low, low_closed, high, high_closed, score in spec.bands:
        cond = F.lit(True)
        if low is not None and low == high:
            cond = c == F.lit(low)
        else:
            if low is not None:
                cond = (c >= F.lit(low)) if low_closed else (c > F.lit(low))
            if high is not None:
                upper = (c <= F.lit(high)) if high_closed else (c < F.lit(high))
                cond = upper if low is None else cond & upper
        out = F.when(cond, F.lit(score)) if out is None else out.when(cond, F.lit(score))
    if spec.missing is None:
        return out
    return out.otherwise(F.lit(spec.missing))


def facebook_score(no_page: Column, city_top: Column, rights: Column, likes_score: Column) -> Column:
    """No page scores 10, a top-city vendor without rights 0, granted rights 10, else by likes."""
    return F.coalesce(
        F.when(no_page == 1, F.lit(10))
        .when((city_top == 1) & (rights == 0), F.lit(0))
        .when(rights == 1, F.lit(10))
        .otherwise(likes_score),
        F.lit(0),
    )


def dish_score(city_top: Column, country_top: Column, stage: Column) -> Column:
    """Photo stage of top vendors only; everybody else scores 10."""
    top = (city_top == 1) | (country_top == 1)
    return (
        F.when(top & stage.isin(4, 5, 7), F.lit(10))
        .when(top & (stage.isin(1, 6) | stage.isNull()), F.lit(0))
        .when(top & (stage == 2), F.lit(5))
        .when(top & (stage == 3), F.lit(7))
        .otherwise(F.lit(10))
    )


# Band edges and scores of the score card.
BINARY = exactly({0: 0, 1: 10})
LADDERS = {
    "commission": rising(
        [0.22, 0.23, 0.24, 0.25, 0.26, 0.27, 0.28, 0.29, 0.30], [0, 1, 3, 4, 5, 6, 7, 8, 9, 10], 0),
    "cr3": rising(
        [0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.225, 0.25, 0.275, 0.3],
        [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 0),
    "price_mark_up": Ladder(((0, True, 0, True, 10), (1, True, None, False, 0)), 0),
    "packaging_quality": exactly({4: 0, 3: 3, 0: 5, 2: 8, 1: 10}, 0),
    "facebook_likes": rising(
        [1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000],
        [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]),
    "reorder_rate": rising(
        [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1],
        [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    "menucategories": ceiling([8, 9, 10, 11, 12, 13, 14], [10, 9, 8, 4, 3, 2, 1, 0], 0),
    # nothing covers 76 to 80 products: they score 0
    "products": Ladder(
        tuple(b for b in ceiling(
            [40, 45, 49, 50, 55, 60, 65, 70, 75, 80, 85],
            [10, 9, 8, 7, 6, 5, 4, 3, 2, None, 1, 0]).bands if b[4] is not None), 0),
    "products_without_description": ceiling(
        [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50],
        [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0], 0),
    "automation": rising(
        [0.82, 0.84, 0.86, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98, 0.99],
        [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    "cancellations": zero_then(
        [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]),
    "processing_time": ceiling(
        [1, 1.3, 1.7, 2, 2.3, 2.7, 3, 3.3, 3.7, 4], [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]),
    # 5.5 itself scores 0
    "revenue": Ladder(
        ((None, False, 5.5, True, 0),)
        + rising([5.5, 6, 6.5, 7, 7.5, 8, 8.5, 9, 9.5, 10],
                 [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]).bands[1:], 0),
    "customer_complaints": zero_then([0.01, 0.02, 0.03, 0.04, 0.05], [8, 7, 6, 4, 2, 0]),
    "closing_hours": zero_then(
        [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]),
}
OPS_SCORES = [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]


def penalty(starts) -> Ladder:
    """Penalty points from 0 up; a negative or missing penalty has no score."""
    first = (starts[0], True, starts[1], False, OPS_SCORES[0])
    return Ladder((first,) + rising(starts[1:], OPS_SCORES).bands[1:])


# Where each score band of the operations penalties starts.
OPS_LADDERS = {
    "overall": penalty([0, 26, 60, 90, 120, 150, 185, 215, 250, 280, 314]),
    "reliability": penalty([0, 4, 29, 53, 78, 102, 127, 151, 176, 200, 225]),
    "prep_time": penalty([0, 9, 15, 21, 27, 33, 40, 46, 52, 58, 64]),
    "waiting": penalty([0, 2, 5, 7, 10, 12, 15, 17, 20, 22, 25]),
}
