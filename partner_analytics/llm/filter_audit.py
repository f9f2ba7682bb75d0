"""Interaction audit of five text filters over all 120 orders in which they can run.

A document's failures form a five-bit mask, and an order treats all documents with one mask alike. So
documents shrink to at most 32 counted cells a part before any order is looked at. Each cell is then
folded across the array of all orders: ``transform`` over the orders, ``aggregate`` over the steps of
one, which gives 600 structs weighted by the cell's counts; a part's cells are merged by elementwise
sums. Everything is built of SQL functions. Only digests and cells are shuffled, never texts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_GAP = r"[\x20\x09-\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A, B, C and D."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail the same filters.

    Equal texts meet by SHA-256. Rows are counted per text, id and flags first, so that a text with
    very many copies is spread over all tasks; its copies then weigh as a few rows in the join with
    the text's smallest id.
    """
    flags = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _own_failures(text).alias("own"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    group = ["digest", "part", "own", "good", "toxic"]
    # rows without an id match no label; their digest spreads them over the tasks of the join
    apart = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(b""))
    flagged = rows.withColumn("apart", apart).join(flags.withColumn("apart", F.lit(b"")), ["doc_id", "apart"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    by_id = flagged.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    same = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = same.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = same.join(least, "digest").select(
        "part", "own", "good", "toxic", F.explode(F.array(
            F.struct(passing.alias("n"), F.lit(0).alias("copy")),
            F.struct((F.col("n") - passing).alias("n"), F.lit(1).alias("copy")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", (F.col("own") + 16 * F.col("x.copy")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def _orders() -> Column:
    """All orders as arrays of filter numbers, one constant."""
    return F.expr("array(" + ", ".join(
        "array(" + ", ".join(map(str, order)) + ")" for order in permutations(range(len(FILTERS)))) + ")")


def _fold(cell: Column, order: Column) -> Column:
    """One cell through one order: an array of a struct for each step."""

    def step(state: Column, bit: Column) -> Column:
        failed = F.call_function("getbit", cell["mask"], bit) == 1
        alive = state["alive"]
        falls = failed & alive
        now = F.struct(
            F.when(alive & ~failed, cell["n"]).otherwise(F.lit(0)).alias("kept"),
            F.when(falls, cell["n"]).otherwise(F.lit(0)).alias("removed"),
            F.when(failed & ~alive, cell["n"]).otherwise(F.lit(0)).alias("redundant"),
            F.when(cell["mask"] == F.call_function("shiftleft", F.lit(1), bit), cell["n"]).otherwise(F.lit(0)).alias("unique_fails"),
            F.when(falls, cell["good"]).otherwise(F.lit(0)).alias("good_lost"),
            F.when(falls, cell["toxic"]).otherwise(F.lit(0)).alias("toxic_lost"))
        return F.struct((alive & ~failed).alias("alive"), F.concat(state["steps"], F.array(now)).alias("steps"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of each (part, filter_order, step), all 600 rows of a part that has documents.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns of either
    are ignored. A null text counts as empty, and so do equal empty texts as copies; a null source is
    the part ''. A row with a null id is no copy and has no label. Rows that repeat an id count each;
    those that share the smallest id of a text all pass filter E. A label counts where any row of its
    id says 1. No documents give no rows.
    """
    merged = cells(docs, labels).groupBy("part").agg(  # 32 cells a part at most
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", "cells", _orders().alias("orders"))

    def add(total: Column, cell: Column) -> Column:
        mine = F.flatten(F.transform(F.col("orders"), lambda order: _fold(cell, order)))
        return F.zip_with(total, mine, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in _COUNTS]))

    zero = F.transform(F.flatten("orders"), lambda _: F.struct(*[F.lit(0).cast("long").alias(c) for c in _COUNTS]))
    summed = merged.select("part", "orders", F.aggregate("cells", zero, add).alias("all"))
    slots = F.transform(F.flatten("orders"), lambda f, i: F.struct(f.alias("f"), F.col("all")[i]["removed"].alias("removed")))
    credit = F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda f: F.aggregate(
        F.filter("slots", lambda s: s["f"] == f), F.lit(0).cast("long"), lambda a, s: a + s["removed"]))
    flat = summed.withColumn("slots", slots).withColumn("credit", credit).select(
        "part", "credit", "orders", F.posexplode("all").alias("at", "x"))
    order, step = F.floor(F.col("at") / len(FILTERS)).cast("int"), F.col("at") % len(FILTERS)
    bits = F.col("orders")[order]
    return flat.select(
        "part", F.array_join(F.transform(bits, lambda b: F.substring(F.lit(FILTERS), b + 1, F.lit(1))), "").alias("filter_order"),
        (step + 1).alias("step"), *[F.col(f"x.{c}").alias(c) for c in _COUNTS],
        F.col("credit")[bits[step]].alias("shapley"))


#: the same table by brute force over (part, mask, order, step)
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
flags AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY 1),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM texts LEFT JOIN flags ON texts.doc_id = flags.doc_id),
marks AS (
  SELECT part, good, toxic, letter, f[letter_no] AS bad, row_no,
         list_sum(f::INT[]) AS n_bad
  FROM (SELECT *, row_number() OVER () AS row_no FROM failed), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 3, 4, 5]) AS letter_no)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
fates AS (
  SELECT row_no, part, good, toxic, filter_order, n_bad,
         min(instr(filter_order, letter)) FILTER (WHERE bad) AS falls, list(letter) FILTER (WHERE bad) AS all_bad
  FROM marks, orders GROUP BY ALL),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
         count(*) FILTER (WHERE falls IS NULL OR falls > step) AS kept,
         count(*) FILTER (WHERE falls = step) AS removed,
         count(*) FILTER (WHERE falls < step AND list_contains(all_bad, substr(filter_order, step, 1))) AS redundant,
         count(*) FILTER (WHERE n_bad = 1 AND list_contains(all_bad, substr(filter_order, step, 1))) AS unique_fails,
         count(*) FILTER (WHERE falls = step AND good = 1) AS good_lost,
         count(*) FILTER (WHERE falls = step AND toxic = 1) AS toxic_lost
  FROM fates, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
