"""Tables that are replaced as a whole or not at all; distinct counts without expansion."""

import pytest
from pyspark.sql import functions as F
from test_plans import SF_DIR, plan

from partner_analytics.catalog import load
from partner_analytics.operators import aggregates, sinks


def rows_of(spark, path):
    return sorted(tuple(r) for r in sinks.read_back(spark, path).collect())


def failing(spark):
    """A write whose last task fails after others have written their files."""
    return spark.range(0, 100, 1, 4).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("k"), F.lit("x").alias("part"))


def test_replaced_table_holds_the_new_rows(spark, tmp_path):
    path = f"{tmp_path}/table"
    sinks.write_replace(spark.sql("SELECT 1L AS k, 'a' AS part"), path)
    sinks.write_replace(spark.sql("SELECT 'other' AS name"), path)
    assert rows_of(spark, path) == [("other",)]
    with pytest.raises(FileNotFoundError):
        sinks.read_back(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("write", [lambda df, path: sinks.write_replace(df, path, ["part"]), lambda df, path: sinks.truncate_insert(df, path, ["part"])])
def test_failed_write_leaves_the_old_rows(spark, tmp_path, write):
    path = f"{tmp_path}/table"
    sinks.write_replace(spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS t(k, part)"), path, ["part"])
    with pytest.raises(Exception, match="broken"):
        write(failing(spark), path)
    assert rows_of(spark, path) == [(1, "a"), (2, "b")]
    write(spark.sql("SELECT 3L AS k, 'c' AS part"), path)
    assert rows_of(spark, path) == [(3, "c")]


def test_table_may_replace_itself(spark, tmp_path):
    path = f"{tmp_path}/table"
    sinks.write_replace(spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS t(k, part)"), path, ["part"])
    sinks.truncate_insert(sinks.read_back(spark, path).where("k = 2").withColumn("k", F.col("k").cast("string")), path, ["part"])
    assert rows_of(spark, path) == [(2, "b")]
    sinks.drop_old(spark, path)
    assert len(list((tmp_path / "table").iterdir())) == 1 and rows_of(spark, path) == [(2, "b")]


def test_distinct_counts_keep_groups_without_values(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 5, 'x'), (1, 5, 'y'), (1, 6, 'x'), (2, NULL, 'x'), (3, 7, NULL) AS t(k, v, c)")
    got = aggregates.distinct_counts(rows, ["k"], F.col("v") * 2, {"xs": F.col("c") == "x", "all": F.lit(True)})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 2), (2, 0, 0), (3, 0, 1)]


@pytest.mark.parametrize("key", ["agg_count_distinct_case", "agg_count_distinct_filter"])
def test_no_row_is_expanded(spark, key):
    assert "Expand" not in plan(load()[key](spark, SF_DIR))
