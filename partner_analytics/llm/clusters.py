"""Linked components of sets by clusters: what lies near a centre is known by its differences from it.

Sets that are close to a centre are known by what they lack of it and add to it: the answers of a set
follow from those of its centre and from the few elements that differ. With r and a the numbers of lacking
and added elements of x and y, and s the elements in which both differ alike,

    |x & y| = |centre| - r_x - r_y + s

so s alone decides. A pair of sets that are both linked with the centre needs no comparison at all, and
for a set that isn't, s has a lower bound above zero, which makes a short list of differing elements the
index of its centre. Pairs across clusters come from lists of elements kept in blocks of like size: a set
is put only into those blocks that its place in the list still lets it reach. All bounds are exact:
clusters decide what is compared, never what is linked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import by_chunk, split, staged
from partner_analytics.llm.graph import components
from partner_analytics.llm.shingles import shingle_set

#: rounds in which sets gather
ROUNDS = 2
#: sets compared with one set in a task
COMPARE = 64
#: prefixes by which sets are dropped are longer by the size of the set over these
PARTS = (20, 4)
#: elements that stand last in the order of prefixes, at most; one in so many sets is counted to find them; sets of those that hold one
LATE, COUNTED, OFTEN = 10_000, 16, 4


def prefix_length(n, percent: int):
    """Elements of a set of which every set that links with it holds one, in any common order."""
    return n - (percent * n + 99) // 100 + 1


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own): the sorted hashes of each of ``nodes`` (node, rep, code, key) as bytes; a text is found by its id and hash."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(text).tobytes() for text in part.column("text").to_pylist()]
        same = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(own, part.column("key").to_pylist())])
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], ["node", "own"]).filter(same)

    # only texts that may be sought are shuffled, one of each set however many copies there are; ``run`` tells wrong picks by the key
    sought = nodes.select(F.xxhash64("rep", "code").alias("pick"), "node", "key")
    texts, _ = split(docs.select("text", F.xxhash64("doc_id", "code").alias("pick")), F.col("pick"), sought.select(F.col("pick").alias("code")))
    return texts.join(sought, "pick").distinct().mapInArrow(by_chunk(run), "node long, own binary")


def of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` without most of those that are not of ``nodes`` (node); hashes of the others need no shuffle."""
    return split(sets, F.xxhash64("node"), nodes.select(F.xxhash64("node").alias("code")))[0]


def longer_prefix(n, percent: int, part: int):
    """Elements of which sets of n and m that link hold 1 + min(n, m) div ``part`` in common, in any common order."""
    return prefix_length(n, percent) + n // part


def common_elements(sets: DataFrame) -> np.ndarray:
    """Elements that many sets hold, ``LATE`` at most, sorted. They only say what stands last, so a few of the sets tell them."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("own").to_pylist()] or [np.empty(0, np.int64)]))], ["element"])

    some = sets.filter(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).select("own")
    often = some.mapInArrow(by_chunk(whole, "own"), "element long").groupBy("element").agg(F.count("*").alias("df")).filter(F.col("df") >= OFTEN)
    return np.sort(often.orderBy(F.desc("df"), "element").limit(LATE).select("element").toArrow().column("element").to_numpy())


def prefixes(sets: DataFrame, percent: int, part: int, late: np.ndarray) -> DataFrame:
    """(elements, node): the first elements of each set in hash order, those of ``late`` last, as many as ``longer_prefix`` says."""

    def part_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for own in batch.column("own").to_pylist():
            x = np.frombuffer(own, np.int64)
            if len(late):
                last = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x
                x = np.concatenate([x[~last], x[last]])
            lists.append(x[:longer_prefix(len(x), percent, part)])
        return pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), batch.column("node")], ["elements", "node"])

    return sets.select("node", "own").mapInArrow(by_chunk(part_of, "own"), "elements array<long>, node long")


def first_elements(sets: DataFrame, percent: int, part: int, late: np.ndarray) -> DataFrame:
    """(element, node): one row for each of the elements of ``prefixes``."""
    return prefixes(sets, percent, part, late).select(F.explode("elements").alias("element"), "node")


def apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """(element) of ``rows`` whose holders differ in each column of ``by``."""
    least = rows.groupBy("element").agg(*[f(c).alias(f"{name}_{c}") for c in by for f, name in ((F.min, "low"), (F.max, "high"))])
    return least.filter(" AND ".join(f"low_{c} < high_{c}" for c in by)).select("element")


def still_open(nodes: DataFrame, sets: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """(node) of ``nodes`` (node, n, columns of ``by``) that may link with one that differs from them in each of ``by``.

    A few more of the first elements tell most sets that have only common phrases with others: of those the
    smallest set that can link with one of n has in common more than percent of n, over ``part``. Only
    sets that pass a short prefix are looked at again with a longer one. Phrases that many sets hold stand
    last in the order, so that sets meet over them only where they have little else.
    """
    late = common_elements(sets)
    for part in PARTS:
        # written once as lists: both uses below read it, and no row of a single element is joined with its node
        lists = staged(prefixes(sets, percent, part, late).join(nodes.select("node", "n", *by), "node"), "prefixes")
        ahead = lists.select(F.explode("elements").alias("element"), "node", "n", *by)
        shared = ahead.join(apart(ahead, by), "element", "left_semi").groupBy("node", "n").agg(F.count("*").alias("shared"))
        live = staged(shared.filter(f"shared > ({percent} * n + 99) div 100 div {part}").select("node"), "open")
        nodes, sets = nodes.join(live, "node", "left_semi"), of_nodes(sets, live) if part != PARTS[-1] else sets
    return live


def gathered(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, centre): the smallest of ``nodes`` met over shared ``buckets`` (node, bucket), in ``ROUNDS`` rounds."""
    label = nodes.select("node", F.col("node").alias("centre"))
    for _ in range(ROUNDS):
        placed = buckets.join(label, "node")
        least = placed.groupBy("bucket").agg(F.min("centre").alias("centre"))
        label = staged(placed.select("node", "bucket").join(least, "bucket").groupBy("node").agg(F.min("centre").alias("centre")), "centres")
    return label


def compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets, or, with ``differences``, all that share half.

    With ``differences`` the columns lacking and added (elements of b that a lacks, and the reverse), n
    (size of a), centre_n (size of b) and linked follow. Each set b meets the sets a in groups of bounded size.
    """
    sets = of_nodes(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / COMPARE).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    heads = dealt.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select("b", "part", F.lit(-1).cast("long").alias("a"), "own")
    members = dealt.join(sets, F.col("a") == F.col("node")).select("b", "part", "a", "own")
    kind = "a long, b long" + (", lacking array<long>, added array<long>, n long, centre_n long, linked boolean" if differences else "")

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lead, out = frame["a"] < 0, []
        b = np.frombuffer(frame.loc[lead, "own"].iloc[0], np.uint64)
        for a, own in zip(frame.loc[~lead, "a"], frame.loc[~lead, "own"]):
            x = np.frombuffer(own, np.uint64)
            if 100 * min(len(x), len(b)) < (50 if differences else percent) * max(len(x), len(b)):
                continue
            both = np.concatenate([x, b])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            linked = 100 * shared >= percent * (len(x) + len(b) - shared)
            if not differences:
                if linked:
                    out.append((int(a), group[0]))
            elif 2 * shared >= max(len(x), len(b)):
                out.append((int(a), group[0], np.setdiff1d(b, x, True).view(np.int64), np.setdiff1d(x, b, True).view(np.int64), len(x), len(b), linked))
        return pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return heads.unionByName(members).groupBy("b", "part").applyInPandas(run, kind)


def better_centres(close: DataFrame) -> DataFrame:
    """(b, centre): the set nearest to all of a cluster, where that isn't its centre ``b``.

    With M sets in a cluster of which df differ from the centre in an element, a set's differences from
    all others, less those of the centre, are the sum of M - 2 df over its differing elements. Only
    elements in which half of the cluster differs make the sum smaller, so only they are counted.
    """
    differs = close.select("a", "b", F.concat(
        F.transform("lacking", lambda v: F.struct(F.lit(0).alias("side"), v.alias("element"))),
        F.transform("added", lambda v: F.struct(F.lit(1).alias("side"), v.alias("element")))).alias("differs"))
    sizes = close.groupBy("b").agg((F.count("*") + 1).alias("m"))
    rows = differs.select("a", "b", F.explode("differs").alias("x")).select("a", "b", "x.side", "x.element")
    common = rows.groupBy("b", "side", "element").agg(F.count("*").alias("df")).join(sizes, "b").filter("2 * df > m").drop("m")
    less = rows.join(common, ["b", "side", "element"]).groupBy("a", "b").agg(F.sum("df").alias("less"))
    cost = differs.select("a", "b", F.size("differs").cast("long").alias("d")).join(sizes, "b").join(less, ["a", "b"]).select(
        "a", "b", (F.col("m") * F.col("d") - 2 * F.col("less")).alias("cost"))
    return cost.filter("cost < 0").groupBy("b").agg(F.min(F.struct("cost", "a"))["a"].alias("centre"))


def in_clusters(close: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a cluster that may be linked and lie in different components.

    ``close`` are the sets near their centre (a, b, lacking, added, n, centre_n, linked), ``labels`` (node,
    component). One of the pair, x, isn't linked with the centre. Let p be the threshold in percent; the
    pair needs (100 + p) s >= p (n_x + n_y) - (100 + p) (|centre| - r_x - r_y). As x misses the centre's
    threshold, that is 1 + 100 r_y + p a_y at least, and p (n_x + |centre|) - (100 + p) (|centre| - r_x) for x.
    """
    unit = 100 + percent
    r, a = F.size("lacking").cast("long"), F.size("added").cast("long")
    own_gap = percent * (F.col("n") + F.col("centre_n")) - unit * (F.col("centre_n") - r)
    base = close.join(labels, close["a"] == labels["node"]).select(
        "node", F.col("b").alias("centre"), "component", "n", "centre_n", "linked", r.alias("r"),
        F.when(F.col("linked"), 1 + 100 * r + percent * a).otherwise(own_gap).alias("gap"),
        F.concat(F.transform("lacking", lambda v: F.struct(F.lit(0).alias("side"), v.alias("element"))),
                 F.transform("added", lambda v: F.struct(F.lit(1).alias("side"), v.alias("element")))).alias("differs"))
    rows = base.filter(unit * F.size("differs") >= F.col("gap")).select("node", "centre", "component", F.explode("differs").alias("x")).select(
        "node", "centre", "component", "x.side", "x.element")
    shared = rows.groupBy("centre", "side", "element").agg(
        F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    useful = rows.join(shared.select("centre", "side", "element", "df"), ["centre", "side", "element"]).groupBy("node", "centre").agg(
        F.array_sort(F.collect_list(F.struct("df", "side", "element"))).alias("own"))  # elements of one set
    keys = staged(useful.join(base.select("node", "centre", "component", "n", "centre_n", "linked", "r", "gap"), ["node", "centre"]).filter(
        unit * F.size("own") >= F.col("gap")).select(
        "node", "centre", "component", "n", "centre_n", "linked", "r", F.size("own").alias("c"),
        F.posexplode(F.slice("own", F.lit(1), (F.size("own") - F.ceil(F.col("gap") / unit) + 1).cast("int"))).alias("place", "x"),
    ).select("node", "centre", "component", "n", "centre_n", "linked", "r", (F.col("c") - F.col("place")).alias("left"), "x.side", "x.element"), "differences")
    x, y = keys.alias("x"), keys.alias("y")
    return x.join(y, F.expr(
        "x.centre = y.centre AND x.side = y.side AND x.element = y.element AND NOT x.linked AND (y.linked OR x.node < y.node) "
        f"AND x.component <> y.component AND {unit} * least(x.left, y.left) >= "
        f"{percent} * (x.n + y.n) - {unit} * (x.centre_n - x.r - y.r)")).select(
            F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _block(n: Column, percent: int) -> Column:
    """Number of the size block; sets that can be linked lie in one block or in neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent * 1.01)).cast("int")


def across_clusters(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, n, component, cluster) that differ in both and may be linked.

    Elements that one component or one cluster holds alone are of no use. The others are ordered by the
    number of sets that hold them, rarest first. The smaller set of a pair is entered into the blocks of
    its own and the next sizes, as far as what is left behind its place can reach the threshold there.
    """
    unit, by = 100 + percent, ["component", "cluster"]
    live = still_open(nodes, sets, percent, by)
    sets = of_nodes(sets, live)

    def explode(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.frombuffer(x, np.int64) for x in part.column("own").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)), *(part.column(c).take(at) for c in ("node", *by))], ["element", "node", *by])

    rows = sets.join(nodes.join(live, "node", "left_semi"), "node").select("node", *by, "own").mapInArrow(
        by_chunk(explode, "own", 1_000_000), "element long, node long, component long, cluster long")
    counts = rows.groupBy("element").agg(F.count("*").alias("df"), *[f(c).alias(f"{name}_{c}") for c in by for f, name in ((F.min, "low"), (F.max, "high"))])
    shared = counts.filter("low_component < high_component AND low_cluster < high_cluster").select("element", "df")
    useful = rows.select("element", "node").join(shared, "element").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "element"))).alias("shared"))  # elements of one set
    size = F.size("shared")
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    keys = staged(useful.join(nodes.select("node", "n", *by), "node").filter(100 * size >= percent * F.col("n")).select(
        "node", "n", *by, size.alias("c"),
        F.posexplode(F.slice("shared", F.lit(1), F.greatest(length - (F.col("n") - size), F.lit(0)).cast("int"))).alias("place", "x"),
    ).select("node", "n", *by, (F.col("c") - F.col("place")).alias("left"), F.col("x.element").alias("element")), "keys")
    y = keys.withColumn("block", _block(F.col("n"), percent))
    # sizes of a block start at the base to the power of its number; the next block holds larger sets only
    start = F.floor(F.pow(F.lit(100 / percent * 1.01), F.col("block")) * (1 - 1e-9))
    x = keys.select("*", F.explode(F.array(_block(F.col("n"), percent), _block(F.col("n"), percent) + 1)).alias("block")).filter(
        unit * F.col("left") >= percent * (F.col("n") + F.greatest("n", start)))
    need = f"{percent} * (x.n + y.n)"
    return x.alias("x").join(y.alias("y"), F.expr(
        "x.element = y.element AND x.block = y.block AND (x.n < y.n OR x.n = y.n AND x.node < y.node) "
        f"AND x.component <> y.component AND x.cluster <> y.cluster AND {unit} * least(x.left, y.left) >= {need}")).select(
            F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def mixed(buckets: DataFrame, *by: str) -> DataFrame:
    """The buckets whose members differ in each of ``by``."""
    ends = buckets.groupBy("bucket").agg(*[f(c).alias(f"{name}_{c}") for c in by for f, name in ((F.min, "low"), (F.max, "high"))])
    return ends.filter(" AND ".join(f"low_{c} < high_{c}" for c in by)).select("bucket")


def linked_components(nodes: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int, within_buckets: bool = False) -> DataFrame:
    """(node, component) of each of ``nodes`` (node, n) that is linked with another.

    ``buckets`` (node, bucket) bring sets together; each node is in one at least. ``sets`` (node, own) are
    sorted hashes as bytes. With ``within_buckets`` only links of nodes that share a bucket are sought
    across clusters, else all.
    """
    centres = gathered(nodes, buckets)
    met = staged(compared(centres.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), sets, percent, True), "close")
    better = staged(better_centres(met).withColumnRenamed("b", "old").withColumnRenamed("centre", "b"), "better")
    again = centres.join(better, F.col("centre") == F.col("old")).filter("node <> b").select(F.col("node").alias("a"), "b")
    close = staged(met.join(better.select(F.col("old").alias("b")), "b", "left_anti").select(*met.columns).unionByName(
        compared(again, sets, percent, True)), "close")
    found = met.filter("linked").select("a", "b").unionByName(close.filter("linked").select("a", "b")).distinct()
    united = components(found)
    of_node = staged(nodes.select("node", "n").join(united, "node", "left").join(
        close.select(F.col("a").alias("node"), F.col("b").alias("cluster")), "node", "left").select(
            "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("cluster", "node").alias("cluster")), "labels")
    inner = in_clusters(close, of_node.select("node", "component"), percent)
    sought, own = of_node, sets
    if within_buckets:
        placed = buckets.join(of_node.select("node", "component", "cluster"), "node")
        sought = of_node.join(placed.join(mixed(placed, "component", "cluster"), "bucket", "left_semi").select("node").distinct(), "node", "left_semi")
        own = of_nodes(sets, sought)
    outer = across_clusters(sought, own, percent)
    more = staged(compared(staged(inner.unionByName(outer).distinct(), "pairs"), sets, percent), "links")
    return united if more.isEmpty() else components(found.unionByName(more))
