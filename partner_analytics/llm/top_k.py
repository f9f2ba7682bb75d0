"""Exact top-k inner products: a top tree deals vectors to shards, each shard is searched in its own k-d tree.

The top tree is made by median splits of a bounded sample; all vectors are dealt to its leaves, and a
leaf is cut into shards of bounded size. The tight bounding box of each leaf is taken over all its
vectors. A task builds the tree of its shard by median splits; every node has the tight bounding box
of its vectors. The best score a box can hold is the inner product with, for each component, the better
of the two box sides. The search takes nodes from a heap, best bound first, and stops when the bound
falls below the query's kth score.

First each query searches one shard of the leaf with the best bound. Its kth score there is a lower
bound that goes with it: it is sent to those leaves only whose box can reach it, and most nodes
there are never opened. A task reads the vectors of a shard and then streams its queries, so vectors
are sent once for each ``BLOCK`` queries that ask for their leaf.
"""

from __future__ import annotations

import heapq

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.llm.common import staged

#: vectors of a shard, queries of a block, vectors of a leaf of a shard's tree
SHARD, BLOCK, LEAF = 1024, 65536, 64
#: leaves of the top tree at most, and their components; vectors that the splits are learnt from, for each leaf
TOP_LEAVES, TOP_VALUES, SAMPLE = 1024, 1 << 20, 8


class Tree:
    """A k-d tree in arrays: nodes with boxes, leaves as ranges of the reordered vectors."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.children, self.range = [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]]
            node = len(self.low)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.children.append([])
            self.range.append((a, b))
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf:
                axis = int(np.argmax(self.high[-1] - self.low[-1]))
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.points = ids[order], points[order]

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, -id) but the query's own id, of those that reach ``floor``."""
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.high @ plus + self.low @ minus
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if -bound < max(kth, floor):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.range[node]
            scores, ids = self.points[a:b] @ query, self.ids[a:b]
            good = np.flatnonzero((scores >= max(kth, floor)) & (ids != own))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[:k]]
            for i in good:
                item = (float(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def top_splits(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the inner nodes of a complete binary tree: node i has the children 2i + 1 and 2i + 2."""
    axis, cut = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
    held = {0: sample}
    for node in range(leaves - 1):
        own = held.pop(node)
        if len(own):
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cut[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] >= cut[node]
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return axis, cut


def matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The chosen rows of a list column, all of length ``dim``."""
    return column.filter(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def dealt_to(points: DataFrame, axis: np.ndarray, cut: np.ndarray, dim: int) -> DataFrame:
    """``points`` (vec_id, asks, x) with the leaf of the top tree; vectors of another length lie in one leaf behind all."""
    leaves = len(axis) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fits = lengths(part.column("x")) == dim
            own, leaf = matrix(part.column("x"), fits, dim), np.full(part.num_rows, leaves)
            node = np.zeros(len(own), np.int64)
            for _ in range(leaves.bit_length() - 1):
                node = 2 * node + 1 + (own[np.arange(len(own)), axis[node]] >= cut[node])
            leaf[fits] = node - (leaves - 1)
            yield part.append_column("leaf", pa.array(leaf, pa.int32()))

    return points.mapInArrow(run, "vec_id long, asks boolean, x array<double>, leaf int")


def boxes_of(dealt: DataFrame, leaves: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the box of each leaf over all its vectors; an empty leaf's can hold no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((leaves, dim), np.inf), np.full((leaves, dim), -np.inf)
        for part in batches:
            leaf = part.column("leaf").to_numpy()
            fits = leaf < leaves
            own = matrix(part.column("x"), fits, dim)
            np.minimum.at(low, leaf[fits], own)
            np.maximum.at(high, leaf[fits], own)
        seen = np.flatnonzero(low[:, 0] < np.inf)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(seen, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(seen)), pa.int32()),
            pa.array(low[seen].ravel()), pa.array(high[seen].ravel())], ["leaf", "i", "low", "high"])

    low, high = np.full((leaves, dim), np.nan), np.full((leaves, dim), np.nan)
    # TOP_VALUES rows at most
    for r in dealt.mapInArrow(run, "leaf int, i int, low double, high double").groupBy("leaf", "i").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        low[r.leaf, r.i], high[r.leaf, r.i] = r.low, r.high
    return low, high


def sent_to(queries: DataFrame, low: np.ndarray, high: np.ndarray, pilot: bool) -> DataFrame:
    """(leaf, query_id, q, floor): the leaf with each query's best bound, or all leaves whose bound reaches its floor."""
    leaves, dim = low.shape
    filled = np.flatnonzero(~np.isnan(low[:, 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                fits = lengths(part.column("q")) == dim
                q, floor = matrix(part.column("q"), fits, dim), part.column("floor").to_numpy()[fits]
                bound = np.maximum(q, 0) @ high[filled].T + np.minimum(q, 0) @ low[filled].T
                if pilot:
                    row, leaf = np.arange(len(q)), filled[bound.argmax(axis=1)]
                else:
                    row, leaf = np.nonzero(bound >= floor[:, None])
                    leaf = filled[leaf]
                others = np.flatnonzero(~fits)
                taken = pa.RecordBatch.from_arrays([part.column(c) for c in ("query_id", "q", "floor")], ["query_id", "q", "floor"]).take(
                    pa.array(np.concatenate([np.flatnonzero(fits)[row], others])))
                yield taken.append_column("leaf", pa.array(np.concatenate([leaf, np.full(len(others), leaves)]), pa.int32()))

    return queries.mapInArrow(run, "query_id long, q array<double>, floor double, leaf int")


FOUND = "query_id long, vec_id long, score long"


def search(dealt: DataFrame, sent: DataFrame, parts: DataFrame, k: int, pilot: bool) -> DataFrame:
    """Candidates (query_id, vec_id, score): the k best of each query in each shard it goes to.

    ``parts`` (leaf, parts) says how many shards a leaf has. A query of ``sent`` (leaf, query_id, q, floor)
    goes to one of them as a pilot, else to all.
    """
    # a row for each leaf of the top tree
    plan = F.broadcast(sent.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(F.broadcast(parts), "leaf"))
    part = F.pmod(F.xxhash64("vec_id", "x"), F.col("parts")).cast("int")
    vectors = dealt.join(plan, "leaf").select(
        "leaf", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.size("x").alias("dim"),
        F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "x", F.lit(0.0).alias("floor"))
    target = F.array(F.pmod(F.xxhash64(F.lit(7), "query_id"), F.col("parts")).cast("int")) if pilot else F.sequence(F.lit(0), F.col("parts") - 1)
    asked = sent.join(plan, "leaf").select(
        "leaf", F.explode(target).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.size("q").alias("dim"),
        F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("x"), "floor")
    key = ["leaf", "part", "block", "dim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in (*key, "kind")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            rows: list[tuple[int, int, int]] = []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                *now, kind = keys[a].tolist()
                if now != group:
                    group, held, tree = now, [], None
                run_of = batch.slice(a, b - a)
                ids, points = run_of.column("id").to_numpy(), matrix(run_of.column("x"), np.ones(b - a, bool), now[-1])
                if kind == 0:
                    held.append((ids, points))
                elif held or tree:
                    if tree is None:
                        tree, held = Tree(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])), []
                    for own, query, floor in zip(ids.tolist(), points, run_of.column("floor").to_pylist()):
                        rows += [(own, -i, int(score)) for score, i in tree.search(own, query, k, floor)]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return vectors.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """No null vector, no null, infinite or NaN component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard: int = SHARD) -> DataFrame:
    """The k highest integer inner products of each query: (query_id, rank, vec_id, score).

    Components become floor(256 * x). Candidates are all rows but those with the query's own id; equal
    scores go by the smaller id. Null ids, and vectors that are null, empty or hold null or non-finite
    components, take no part; repeated rows are searched once, as (id, vector) pairs. Several vectors of
    one query id ask together: the ranking has the k best pairs of one of them and a candidate vector.
    Vectors of another length than the query's are no candidates; only those of the commonest length
    are dealt by the top tree. Scores are exact while sums stay below 2^53.
    """
    vector = F.col(vector_col).cast("array<double>")
    points = staged(vectors.filter(F.col(id_col).isNotNull() & usable(vector) & (F.size(vector) > 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"),
        F.transform(vector, lambda x: F.floor(256 * x).cast("double")).alias("x")).distinct(), "vectors")
    common = points.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, count = (common["dim"], common["count"]) if common else (1, 0)
    most = max(1, min(TOP_LEAVES, TOP_VALUES // dim, -(-count // shard)))
    leaves = 1 << (most.bit_length() - 1)
    sample = points.filter(F.size("x") == dim).orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE * leaves).select("x").collect()
    axis, cut = top_splits(np.array([r.x for r in sample]).reshape(-1, dim), leaves)
    dealt = staged(dealt_to(points, axis, cut, dim), "dealt")
    low, high = boxes_of(dealt, leaves, dim)
    parts = staged(dealt.groupBy("leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")), "parts")

    queries = dealt.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    first = sent_to(queries.withColumn("floor", F.lit(float("-inf"))), low, high, True)
    floors = best_of(search(dealt, first, parts, k, True), k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    bounded = staged(queries.join(floors, "query_id", "left").select(
        "query_id", "q", F.coalesce(F.when(F.col("n") == k, F.col("kth")).cast("double"), F.lit(float("-inf"))).alias("floor")), "queries")
    return best_of(search(dealt, sent_to(bounded, low, high, False), parts, k, False), k).select("query_id", "rank", "vec_id", "score")
