"""Trie of conversation prefixes, counted in minimal-perfect-hash node tables.

A prefix is named by a 128-bit digest: the sum of one hash for each turn and place, so that digests are
running sums and a conversation of any length may be cut between tasks. Rows (conversation, place) are
dealt in sorted slices of bounded size, whatever one conversation holds. In a slice the distinct digests
get the slots of a minimal perfect hash; the digest stored at a slot, its parent, depth and last turn
are compared with every row that lands there, and once more when slices are merged. A digest that two
prefixes share is thus found, and the work starts again with other hashes.

Every node is owned by the slice that holds the row of its smallest member. What a node adds to the
nodes above it is scattered into flat arrays of its owner's slice and accumulated through parent slots,
deepest first. A prefix that reaches several slices adds up their sums, as each node counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import GOLDEN, mix, staged

#: rows that a slice holds, about
SLICE = 500_000
GROUP, SHARED = 100, 6  # conversations rebuilt from one, and the bound of the turns they take from it
#: conversation ids joined into one string before they are hashed
RUN = 1000

_NO_SLOT = -1


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests, as levels of cells that hold one digest each."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        self.size = len(a)
        self.a, self.b = np.empty(self.size, np.uint64), np.empty(self.size, np.uint64)
        self.levels: list[np.ndarray] = []
        base = 0
        while len(a):
            cells = len(a) + len(a) // 2 + 1
            at = self._cell(a, b, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells)[at] == 1
            slots = np.full(cells, _NO_SLOT, np.int64)
            slots[at[alone]] = base + np.arange(int(alone.sum()))
            self.levels.append(slots)
            self.a[slots[at[alone]]], self.b[slots[at[alone]]] = a[alone], b[alone]
            base += int(alone.sum())
            a, b = a[~alone], b[~alone]

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(mix(a + GOLDEN * np.uint64(level + 1)) ^ b) % np.uint64(cells)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, ``_NO_SLOT`` where the table does not hold it."""
        out, left = np.full(len(a), _NO_SLOT, np.int64), np.arange(len(a))
        for level, slots in enumerate(self.levels):
            hit = slots[self._cell(a[left], b[left], level, len(slots))]
            out[left[hit >= 0]] = hit[hit >= 0]
            left = left[hit < 0]
        held = np.flatnonzero(out >= 0)
        wrong = (self.a[out[held]] != a[held]) | (self.b[out[held]] != b[held])
        out[held[wrong]] = _NO_SLOT
        return out


def _array(table, name: str, kind=np.int64) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(kind)


def _turn_hash(place: np.ndarray, c1: np.ndarray, c2: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn at its place; place 0, the root, adds nothing."""
    with np.errstate(over="ignore"):
        at = mix(place.astype(np.uint64) * GOLDEN + np.uint64(seed))
        x = mix(mix(c1 + at) ^ c2)
        y = mix(mix(c2 + GOLDEN + at) ^ c1)
    x[place == 0], y[place == 0] = 0, 0
    return x, y


def _cumulated(values: np.ndarray, starts: np.ndarray, before) -> np.ndarray:
    """Running sums that begin anew at ``starts``; ``before`` is added to the first run."""
    with np.errstate(over="ignore"):
        total = np.cumsum(values, dtype=values.dtype)
        skip = np.zeros(len(starts), values.dtype)
        skip[1:] = total[starts[1:] - 1]
        skip[0] -= before
        return total - np.repeat(skip, np.diff(np.append(starts, len(values))))


def _run_starts(conv: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` in sorted slices of about ``SLICE`` rows, numbered in order."""
    count = rows.count()
    return rows.repartitionByRange(-(-count // SLICE) or 1, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation inside a slice."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = _array(batch, "conv")
        starts = _run_starts(conv)
        own = _cumulated(np.ones(len(conv), np.int64), starts, count if conv[0] == last else 0)
        last, count = conv[-1], own[-1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("slice", "conv", "c1", "c2", "chars")), pa.array(own)],
            ["slice", "conv", "c1", "c2", "chars", "place"])


def _carried(ends: list, zero, add) -> dict[int, tuple]:
    """{slice: (conversation, what earlier slices hold of it)} of each slice that goes on with one.

    ``ends`` is (slice, first conversation, last conversation, value of the last one), a row a slice.
    """
    out, before, value = {}, None, zero
    for number, first, last, own in sorted(ends, key=lambda e: e[0]):
        if before == first:
            out[number] = (first, value)
            value = add(value, own) if last == first else own
        else:
            value = own
        before = last
    return out


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, c1, c2, chars): the turns of each conversation in order, from place 1 on.

    A null turn comes first; turns with one number follow the SHA-256 of role and text. ``c1`` and ``c2``
    are 128 bits of it, so that no text is moved.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda start: F.conv(F.substring("digest", start, 16), 16, -10).cast("long")
    plain = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars")).select("conv", "turn", half(1).alias("c1"), half(17).alias("c2"), "chars")
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("c1").asc(), F.col("c2").asc()]
    numbered = staged(_dealt(plain, order).mapInArrow(
        _number, "slice int, conv long, c1 long, c2 long, chars long, place long"), "turns")
    ends = numbered.groupBy("slice").agg(
        F.min("conv"), F.max("conv"), F.max(F.struct("conv", "place"))["place"]).collect()  # a row a slice
    skips = [(s, c, v) for s, (c, v) in _carried([tuple(e) for e in ends], 0, lambda a, b: a + b).items()]
    skip = rows.sparkSession.createDataFrame(skips, "slice int, conv long, skip long")
    return numbered.join(F.broadcast(skip), ["slice", "conv"], "left").select(
        "conv", (F.col("place") + F.coalesce("skip", F.lit(0))).alias("place"), "c1", "c2", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv, place, length, c1, c2, chars): each conversation after the exchange of its first turns, with its root.

    The first h turns are those of the conversation at the next multiple of 100 towards zero, all of them
    where it has fewer; h is the crc32 of the id modulo 6.
    """
    head = own.filter(F.col("conv") % GROUP == 0).filter(F.col("place") < SHARED).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "c1", "c2", "chars"))).alias("head"))  # SHARED - 1 turns at most
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"), h.alias("h")).join(head, "base", "left").select(
            "conv", "h", F.slice(F.coalesce("head", F.array().cast(head.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")).alias("head"), "n"
        ).select("conv", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    root = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("place", "c1", "c2", "chars")])
    first = convs.select("conv", "length", F.explode(F.concat(F.array(root), "head")).alias("x")).select(
        "conv", "x.place", "length", "x.c1", "x.c2", "x.chars")
    rest = own.join(convs.select("conv", "h", F.size("head").alias("k"), "length"), "conv").filter("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "length", "c1", "c2", "chars")
    return first.unionByName(rest)


def _digests(seed: int):
    """Running digests of each conversation inside a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, (np.uint64(0), np.uint64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = _array(batch, "conv")
            starts = _run_starts(conv)
            hashes = _turn_hash(_array(batch, "place"), _array(batch, "c1", np.uint64), _array(batch, "c2", np.uint64), seed)
            own = [_cumulated(x, starts, b if conv[0] == last else np.uint64(0)) for x, b in zip(hashes, before)]
            last, before = conv[-1], (own[0][-1], own[1][-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(d.view(np.int64)) for d in own)], [*batch.schema.names, "d1", "d2"])

    return run


def prefixes(places: DataFrame, seed: int) -> DataFrame:
    """``places`` (conv, place, ...) in slices, with the digests of the prefix that ends there (d1, d2) and of its parent (p1, p2)."""
    fields = "conv long, place long, length long, c1 long, c2 long, chars long, slice int, d1 long, d2 long"
    sliced = staged(_dealt(places.select("conv", "place", "length", "c1", "c2", "chars"), [F.col("conv"), F.col("place")]).mapInArrow(
        _digests(seed), fields), "prefixes")
    ends = sliced.groupBy("slice").agg(
        F.min("conv"), F.max("conv"), F.max(F.struct("conv", "place", "d1", "d2")).alias("x")).collect()  # a row a slice
    add = lambda a, b: tuple((x + y) % (1 << 64) for x, y in zip(a, b))
    carried = _carried([(e[0], e[1], e[2], (e["x"]["d1"], e["x"]["d2"])) for e in ends], (0, 0), add)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = _array(batch, "slice"), _array(batch, "conv")
            own = [_array(batch, c, np.uint64).copy() for c in ("d1", "d2")]
            for number in np.unique(part):
                if int(number) in carried:
                    first, value = carried[int(number)]
                    on = (part == number) & (conv == first)
                    for d, v in zip(own, value):
                        d[on] += np.uint64(v % (1 << 64))
            last = _turn_hash(_array(batch, "place"), _array(batch, "c1", np.uint64), _array(batch, "c2", np.uint64), seed)
            extra = [pa.array(x.view(np.int64)) for x in (*own, *(d - x for d, x in zip(own, last)))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names[:-2]), *extra], [*batch.schema.names, "p1", "p2"])

    return sliced.mapInArrow(whole, fields + ", p1 long, p2 long")


_NODE = ["p1", "p2", "place", "c1", "c2", "chars"]


def _slots(table: pa.Table) -> tuple[SlotTable, np.ndarray, dict[str, np.ndarray], bool]:
    """The slot table of a slice, each row's slot, the node columns by slot, and whether rows of a slot agree."""
    d1, d2 = _array(table, "d1", np.uint64), _array(table, "d2", np.uint64)
    slots = SlotTable(d1, d2)
    at = slots.find(d1, d2)
    columns, same = {}, True
    for name in _NODE:
        value = _array(table, name)
        columns[name] = np.empty(slots.size, np.int64)
        columns[name][at] = value
        same &= bool((columns[name][at] == value).all())
    return slots, at, columns, same


def _local_nodes(table: pa.Table) -> pa.Table:
    slots, at, columns, same = _slots(table)
    least = np.full(slots.size, np.iinfo(np.int64).max)
    np.minimum.at(least, at, _array(table, "conv"))
    part = table.column("slice")[0].as_py()
    return pa.table({
        "d1": slots.a.view(np.int64), "d2": slots.b.view(np.int64), **columns, "conv": least,
        "n": np.bincount(at, minlength=slots.size), "slice": np.full(slots.size, part, np.int32), "same": np.full(slots.size, same)})


def nodes_of(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The nodes of all slices merged, and whether each digest stands for one prefix."""
    kinds = ", ".join(f"{c} long" for c in ["d1", "d2", *_NODE, "conv", "n"])
    local = rows.groupBy("slice").applyInArrow(_local_nodes, f"{kinds}, slice int, same boolean")
    content = F.struct(*_NODE)
    merged = staged(local.groupBy("d1", "d2").agg(
        F.min(content).alias("x"), F.max(content).alias("y"), F.sum("n").alias("n_convs"),
        F.min(F.struct("conv", "slice")).alias("owner"), F.min("same").alias("same")), "nodes")
    sound = merged.filter("x <> y OR NOT same").isEmpty()
    return merged.select("d1", "d2", "x.p1", "x.p2", F.col("x.place").alias("depth"), "x.chars", "n_convs", "owner.conv", "owner.slice"), sound


def _later(weights: DataFrame, rows: DataFrame) -> dict[int, tuple[int, int]]:
    """{slice: (leaves, saved)} that the slice's last conversation owns in later slices and that don't pass on there.

    Where a slice starts inside a conversation, the parent of its first row may still be in it, through
    another conversation with all that is above; then sums go up in that slice and nothing is left over.
    """
    spark, least = rows.sparkSession, F.min(F.struct("conv", "place", "p1", "p2"))
    spans = sorted((r[0], r["x"]["conv"], r["last"], r["x"]["p1"], r["x"]["p2"]) for r in rows.groupBy("slice").agg(
        least.alias("x"), F.max("conv").alias("last")).collect())  # a row a slice
    cut = [b for a, b in zip(spans, spans[1:]) if a[2] == b[1]]
    if not cut:
        return {}
    heads = spark.createDataFrame([(s, p, q) for s, _, _, p, q in cut], "slice int, d1 long, d2 long")
    closed = {r["slice"] for r in rows.join(F.broadcast(heads), ["slice", "d1", "d2"], "left_semi").select("slice").distinct().collect()}
    firsts = spark.createDataFrame([(s, c) for s, c, *_ in cut if s not in closed], "slice int, conv long")
    owned = {r["slice"]: (r["leaves"], r["saved"]) for r in weights.join(F.broadcast(firsts), ["slice", "conv"]).groupBy("slice").agg(
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).collect()}  # a row a slice at most
    out = {}
    for (number, _, last, *_), (after, first, end, *_) in zip(spans[-2::-1], spans[:0:-1]):
        if last == first:
            own, more = owned.get(after, (0, 0)), out.get(after, (0, 0)) if first == end else (0, 0)
            out[number] = (own[0] + more[0], own[1] + more[1])
    return out


def _accumulated(later: dict[int, tuple[int, int]]):
    """Sums of a slice's own weights over the prefixes above them, through parent slots from the deepest up."""

    def run(table: pa.Table, weights: pa.Table) -> pa.Table:
        slots, at, columns, _ = _slots(table)
        sums = np.zeros((2, slots.size), np.int64)
        own = slots.find(_array(weights, "d1", np.uint64), _array(weights, "d2", np.uint64))
        sums[0, own], sums[1, own] = _array(weights, "leaf"), _array(weights, "saved")
        part = table.column("slice")[0].as_py()
        if part in later:
            conv, place = _array(table, "conv"), _array(table, "place")
            sums[:, at[np.lexsort((place, conv))[-1]]] += np.asarray(later[part])
        depth = columns["place"]
        parent = slots.find(columns["p1"].view(np.uint64), columns["p2"].view(np.uint64))
        parent[depth == 0] = _NO_SLOT
        order = np.argsort(-depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            level = level[parent[level] >= 0]
            np.add.at(sums[0], parent[level], sums[0, level])
            np.add.at(sums[1], parent[level], sums[1, level])
        return pa.table({"d1": slots.a.view(np.int64), "d2": slots.b.view(np.int64), "leaves": sums[0], "saved": sums[1]})

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the sorted runs of ids of each node, one run after the other."""
    names, key, state = ["d1", "d2", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
            if (d1, d2) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (d1, d2), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names)


def ends(rows: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of each node where a conversation ends. Only joined ids reach one task a node, as a stream."""
    runs = rows.filter("place = length").groupBy("d1", "d2", F.floor(F.col("conv") / F.lit(RUN)).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))  # RUN ids at most
    return runs.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "run").mapInArrow(
        _hash_ends, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, from the textless root on.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest
    member, turns, the parent's smallest member (null at the root), members, children, childless nodes
    of the subtree, the members but one times the characters of the last turn summed over the subtree,
    and the SHA-256 of the sorted ids of members that end here.

    A null role or text counts as empty; null turns come first, equal turns follow the digest of role and
    text, and repeated rows are turns of their own. Rows with a null conversation id take no part. Ids are
    integers. Texts may have any length; other columns are ignored. No conversations give no rows.
    """
    places = staged(rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col)), "places")
    seed = 0
    while True:
        rows = prefixes(places, seed)
        nodes, sound = nodes_of(rows)
        if sound:
            break
        seed += 1
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    weights = nodes.select("slice", "conv", "d1", "d2", (F.col("n_children") == 0).cast("long").alias("leaf"),
                           ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    summed = rows.groupBy("slice").cogroup(weights.groupBy("slice")).applyInArrow(
        _accumulated(_later(weights, rows)), "d1 long, d2 long, leaves long, saved long").groupBy("d1", "d2").agg(
            F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # the root has most children; its smallest member is one value
    root = nodes.filter("depth = 0").select("conv").first()
    parents = nodes.filter("depth > 0 AND n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))
    out = nodes.join(summed, ["d1", "d2"]).join(ends(rows), ["d1", "d2"], "left")
    top = out.filter("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(root and root[0]).cast("long")))
    low = out.filter("depth > 1").join(parents, ["p1", "p2"])
    return top.unionByName(low).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: prefixes as joined digests of their turns, ancestors by a join on the smallest member
ORACLE_SQL = r"""
WITH ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.place, o.digest, o.chars FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.place, o.digest, o.chars FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
placed AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
paths AS (
  SELECT conv_id, depth, key, CASE WHEN depth = 1 THEN '' ELSE left(key, length(key) - 64) END AS parent, chars FROM placed
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY 1),
nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(p.conv_id) AS conv_id,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON p.conv_id = l.conv_id GROUP BY key),
sized AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1) c ON n.key = c.parent),
below AS (
  SELECT p.key, sum((s.n_children = 0)::INT)::BIGINT AS n_leaves, sum((s.n_convs - 1) * s.chars)::BIGINT AS saved_tokens
  FROM sized s JOIN paths p ON p.conv_id = s.conv_id AND p.depth <= s.depth GROUP BY 1)
SELECT s.conv_id, s.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens, s.ends_sha256
FROM sized s JOIN below b ON s.key = b.key LEFT JOIN nodes u ON u.key = s.parent
"""
