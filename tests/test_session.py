from pyspark.sql import functions as F

from partner_analytics.session import tune


def test_parts_of_a_shuffle_are_small(spark):
    """What a task sorts or aggregates is bounded: more input makes more parts, not larger ones."""
    rows = tune(spark).range(12_000_000).select("id", F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    parts = rows.repartition("id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("a"), F.max("b")).collect()
    assert len(parts) > 10  # 190 MB of hashes that do not compress
