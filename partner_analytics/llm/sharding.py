"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group. Groups whose share of any dimension is large, and groups of many
rows, are split into parts (their number follows from the share), so that none outweighs a shard and
none lands in one task. The parts are dealt to cells of a bounded size by hash. Each cell fills all
shards: its parts go one by one, largest first, to the shard where the dot product of the part's
vector with the shard's residual capacity is highest. Capacities are a cell's own totals divided by
the number of shards, so that equal cells add up to equal shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.llm.common import staged

SHARDS = 8
#: parts in a cell on average; a group is split when a dimension of it exceeds 1/SPLIT of that dimension's total
CELL, SPLIT = 4096, 1024
#: rows that a part may hold
PART_ROWS = 4096


def place(vectors: np.ndarray, shards: int, turn: int) -> np.ndarray:
    """The shard of each row of ``vectors`` (parts x dimensions)."""
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total, 1) * shards  # a shard's capacity is 1 in each dimension
    room = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), np.int32)
    first = (np.arange(shards) + turn) % shards  # equal scores: the shard to start with differs by cell
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        at = int(first[np.argmax((room[first] * scaled[i]).sum(axis=1))])
        out[i] = at
        room[at] -= scaled[i]
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          cell: int = CELL) -> DataFrame:
    """Deals all rows to ``shards`` shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1, no tokens and the checksum 0 of no bytes. Null ids, repeated rows and
    empty texts are rows like all others. The law is ``bytes``: sizes of the shards are near equal.
    """
    text = F.col(text_col)
    rows = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
    ), "rows")
    # one row, then at most 3 * SPLIT + (rows / PART_ROWS) ids of large groups
    totals = rows.agg(F.sum("size").alias("all_size"), F.sum("tokens").alias("all_tokens"), F.count("*").alias("all_rows"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = F.greatest(F.col("size") / F.col("all_size"), F.col("tokens") / F.greatest("all_tokens", F.lit(1)),
                       F.col("n") / F.col("all_rows")) * SPLIT
    split = groups.join(F.broadcast(totals)).select(
        "key", F.ceil(F.greatest(share, F.col("n") / PART_ROWS)).cast("int").alias("parts")).filter("parts > 1")
    dealt = rows.join(split, "key", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int"))
    parts = dealt.groupBy("key", "part").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    parts = staged(parts, "parts")
    cells = max(1, -(-parts.count() // cell))

    def fill(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "part"]).reset_index(drop=True)
        at = place(frame[["size", "tokens", "n"]].to_numpy(np.float64), shards, int(group[0]))
        return pd.DataFrame({"key": frame["key"], "part": frame["part"], "cell": frame["cell"], "shard": at})

    placed = parts.withColumn("cell", F.pmod(F.xxhash64("key", "part"), F.lit(cells))).groupBy("cell").applyInPandas(
        fill, "key binary, part int, cell long, shard int")
    out = staged(dealt.join(placed, ["key", "part"]).select(
        "row", "doc_id", "size", "text_crc32", "cell", "shard"), "placed")
    # places inside a shard: cells come one after another, rows inside a cell by their number
    counts = out.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = out.withColumn("at", F.row_number().over(Window.partitionBy("cell", "shard").orderBy("row")) - 1)
    return inside.join(base, ["cell", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
