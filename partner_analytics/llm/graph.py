"""Connected components of a link table, by union steps on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its smallest node.

    Each round joins every node to the smallest node it knows: first its larger neighbours (large
    star), then its smaller ones (small star), until nothing changes. Minima are partial aggregates;
    joins on a hub are ordinary skew joins. Links of a node to itself are ignored; an empty table
    gives an empty result.
    """
    edges = staged(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    inner = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = inner.select("component").distinct().select(F.col("component").alias("node"), "component")
    return inner.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
