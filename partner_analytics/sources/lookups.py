"""Inline parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partner_analytics.sources.tables import inline

# CRM opportunity type, points, lifespan in days, area, lowest count, lowest score
# and record type id. Photo opportunities have no lifespan and no area.
OPPORTUNITY_ROWS = """
('Partner - Commission Renegotiation', 1.6, 28, 'Commercial', 0, 0, '01224000000FIia'),
('Partner - Gain Exclusivity', 1.6, 28, 'Commercial', 0, 0, '01224000000FIif'),
('Partner - In-Restaurant Material', 0.5, 7, 'Marketing-2', 0, 0, '012240000002ohY'),
('Partner - Improve Menu/CR', 0.7, 7, 'Content', 0, 0, '01224000000FIiu'),
('Partner - Automation Improvement', 0.35, 7, 'Operations', 0, 0, '012240000002ohW'),
('Partner - Improve Cancellations', 0.35, 7, 'Operations', 0, 0, '012240000002ohX'),
('Partner - FB Advertiser Rights', 0.8, 14, 'Marketing', 2, 4, '01224000000FIip'),
('Partner - Packaging', 0.7, 21, 'Operations', 0, 0, '01224000000fx8N'),
('Partner - Improvement Prep-Time/Vendor Delay', 0.35, 7, 'Operations', 0, 0, '01224000000FIik'),
('Partner - OM Backlink', 1.0, 14, 'Marketing', 0, 0, '01224000000gDr1'),
('Partner - OM Whitelabel', 1.0, 14, 'Marketing', 0, 0, ''),
('Partner - Dish Level Photos', 1.6, NULL, NULL, 0, 0, ''),
('Partner - Pickup Activation', 1.0, 21, 'Commercial-2', 0, 0, '012240000002rT3'),
('Partner - Improve Offline Hours', 0.35, 7, 'Operations', 0, 0, '012240000006ucY'),
('Partner - Improve Customer Complaints', 0.35, 7, 'Operations', 0, 0, '01224000000kPkF')
"""
OPPORTUNITY_COLUMNS = (
    "opportunity, opportunity_points, lifespan_days, opportunity_area, low_limit_absolute, "
    "low_limit_scoring, record_type_id")

# Cuisine ids per banner.
CUISINES = {
    "american": [19, 18, 17, 83, 54, 3, 81],
    "arabic": [30, 76, 82, 72, 64, 106],
    "argentinian": [51, 67, 29, 80, 124, 79, 43],
    "asian": [7, 46, 28, 92, 68, 41, 88, 125, 6, 8],
    "cakes_bakery": [9, 128, 22, 38, 60, 16, 42],
    "european": [15, 13, 66, 97, 37, 89, 84, 34, 49, 47],
    "healthy_food": [65, 26, 116, 104, 10, 25, 131, 21],
    "indian": [12, 91, 69, 101],
    "international": [11, 52, 122, 27, 39, 112, 40, 57, 32, 48, 86, 93],
    "italian": [1, 35, 5],
    "mexican": [2, 53],
    "oriental": [44, 110, 45, 33, 63, 55, 31, 23],
    "seafood": [14, 50],
    "sushi": [20, 4],
}
DEFAULT_CUISINE = "european"


def opportunity_params(spark: SparkSession) -> DataFrame:
    """Points, lifespan, area, limits and record type id per opportunity type."""
    rows = inline(spark, OPPORTUNITY_COLUMNS, OPPORTUNITY_ROWS)
    return rows.where("opportunity_points IS NOT NULL AND record_type_id IS NOT NULL").selectExpr(
        "opportunity", "CAST(opportunity_points AS DECIMAL(6,2)) AS opportunity_points", "lifespan_days",
        "opportunity_area", "low_limit_absolute", "low_limit_scoring", "record_type_id")


def banners(spark: SparkSession, template: str = "{}_banner.jpg") -> DataFrame:
    """Cuisine id to banner file."""
    rows = ", ".join(
        f"({cuisine}, '{template.format(kind)}')" for kind, ids in CUISINES.items() for cuisine in ids)
    return inline(spark, "cuisine_id, banner", rows)
