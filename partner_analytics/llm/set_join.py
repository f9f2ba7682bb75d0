"""Exact Jaccard join of shingle sets that skips by relations between sets.

Two relations spare comparisons, both in ``clusters.py``. Sets of an index list are kept in blocks of
like size, and a set is put only into those blocks that its place in the list still lets it reach (*index
level*). And the answers of a set are derived from those of a highly similar one, its centre, and from
the few elements in which the two differ (*answer level*).

Steps: equal sets become one node. Nodes that share too few of their first elements in hash order with
other nodes have no link and go. Nodes gather over MinHash buckets and are compared with the smallest of
them, and once more with the set nearest to all, the centre, where that is another. Pairs inside a
cluster come from the index of differences, pairs across clusters from the blocked index, both only
between components that are still apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.clusters import linked_components, prefix_length, sets_of
from partner_analytics.llm.common import GOLDEN, by_chunk, mix, staged, width
from partner_analytics.llm.shingles import shingle_set

PERCENT = 80
#: first elements that one part of them holds; they are a quarter of all
PART_ELEMENTS = 1_000_000
#: MinHash values by which nodes gather
MARKS = 3


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code, n_shingles, key, marks) of ``docs`` (doc_id, text, code); the key is null where the set is empty."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, marks = [], [], []
        for text in part.column("text").to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            with np.errstate(over="ignore"):
                marks.append([int(mix(found + GOLDEN * np.uint64(i + 1)).min().view(np.int64)) for i in range(MARKS)] if len(found) else [])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("code"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
            ["doc_id", "code", "n_shingles", "key", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(by_chunk(run), f"doc_id {kind}, code long, n_shingles long, key binary, marks array<long>")


def _longer_prefix(n: int, percent: int) -> int:
    """Elements of which sets of n and m that link hold one more than min(n, m) div 20 in common, in any common order."""
    return min(n, prefix_length(n, percent) + n // 20)


def shared_counts(docs: DataFrame, percent: int, parts: int = 64) -> DataFrame:
    """(code, n): how many of a text's first elements in hash order other sets hold among theirs, or more.

    Elements are dealt to ``parts`` by their hash. A chunk of texts sends one row to each part: 32 bits of each
    element in it, once, and the place of its text among the chunk's, or that several hold it; what texts of one
    chunk share is settled there. Elements that agree in part and 32 bits count as one, so ``parts`` has to grow
    with the input (``PART_ELEMENTS``): then about one in 4,000 is taken for shared that isn't.
    """

    def first(part: pa.RecordBatch) -> pa.RecordBatch:
        lists, codes, seen = [], [], set()
        for code, text in zip(part.column("code").to_pylist(), part.column("text").to_pylist()):
            if code not in seen:
                seen.add(code)
                found = shingle_set(text)
                lists.append(found[:_longer_prefix(len(found), percent)] if len(found) else found)
                codes.append(code)
        codes = np.asarray(codes, np.int64)
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        element = mix(np.concatenate(lists)) if lists else np.empty(0, np.uint64)
        order = np.argsort(element, kind="stable")
        element, at = element[order], at[order]
        start = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(element)))
        local = np.bincount(at[np.repeat(size > 1, size)], minlength=len(codes)) if len(element) else np.zeros(len(codes), np.int64)
        # one of each: its text, or -1 where several hold it
        low, owner, to = element[start].astype(np.uint32), np.where(size > 1, -1, at[start]), (element[start] >> np.uint64(32)) % np.uint64(parts)
        rows = []
        for number, own in zip(*_grouped(to)):
            texts, place = np.unique(owner[own], return_inverse=True)
            several = bool(texts[0] < 0)  # then place 0 stands for them
            rows.append((int(number), low[own].tobytes(), place.astype(np.uint16 if len(texts) <= 65536 else np.uint32).tobytes(),
                         codes[texts[several:]].tobytes(), several, b""))
        has = local > 0
        if has.any():
            rows.append((int(codes[has][0] % parts), b"", b"", codes[has].tobytes(), False, local[has].astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    def settle(table: pa.Table) -> pa.Table:
        """What all chunks sent to one part; a text is counted once in an element, however many copies of it came."""
        low, code, several, out_code, out_n = [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, elements, places, codes, first_several, local in zip(*(table.column(c).to_pylist() for c in names)):
            own = np.frombuffer(codes, np.int64)
            if local:
                out_code.append(own)
                out_n.append(np.frombuffer(local, np.int64))
                continue
            element = np.frombuffer(elements, np.uint32)
            place = np.frombuffer(places, np.uint16 if len(places) == 2 * len(element) else np.uint32)
            low.append(element)
            code.append(np.concatenate([[0], own] if first_several else [own])[place])
            several.append((place == 0) & first_several)
        if low:
            element, code, several = np.concatenate(low), np.concatenate(code), np.concatenate(several)
            order = np.lexsort((several, code, element))
            element, code, several = element[order], code[order], several[order]
            start = np.concatenate([[True], (element[1:] != element[:-1]) | (code[1:] != code[:-1]) | (several[1:] != several[:-1])])
            element, code, several = element[start], code[start], several[start]  # one row for each text
            begin = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
            size = np.diff(np.append(begin, len(element)))
            hit = np.repeat((size > 1) | np.logical_or.reduceat(several, begin), size) & ~several
            for x, target in zip(np.unique(code[hit], return_counts=True), (out_code, out_n)):
                target.append(x)
        return pa.table({"code": np.concatenate(out_code), "n": np.concatenate(out_n).astype(np.int64)})

    names, kinds = ["part", "elements", "places", "codes", "several", "local"], [pa.int32(), *[pa.binary()] * 3, pa.bool_(), pa.binary()]
    rows = docs.mapInArrow(by_chunk(first), "part int, elements binary, places binary, codes binary, several boolean, local binary")
    return rows.groupBy("part").applyInArrow(settle, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _grouped(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values, and where each stands."""
    order = np.argsort(values, kind="stable")
    found, start = np.unique(values[order], return_index=True)
    return found, np.split(order, start[1:]) if len(found) else []


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents link where 100 * intersection >= ``percent`` * union of their distinct 5-word shingles
    (A-Z lower-cased; fewer words make one shingle); ``component_id`` is the smallest id reachable. A null,
    empty or blank text has no shingle and is linked with nothing. Repeated rows and equal sets share a
    component. Null ids are larger than all others: a component of null ids only has a null one.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("code"))
    rows = staged(fingerprints(source), "rows")
    nodes = staged(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("doc_id", "code")).alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "code"))).alias("named"),
        F.first("marks").alias("marks"), F.first("n_shingles").alias("n")).select(
            "key", "marks", "n", F.coalesce("named", "least").alias("x")).select(
                F.monotonically_increasing_id().alias("node"), "key", "marks", "n", F.col("x.doc_id").alias("rep"), "x.code"), "nodes")
    texts = rows.filter("key IS NOT NULL").select("code", "key").distinct()
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    holds = texts.join(shared_counts(source, percent, max(width(source.sparkSession), total // (4 * PART_ELEMENTS))), "code").groupBy("key").agg(F.max("n").alias("shared"))
    # a set that links with one of n has percent of n elements at least
    live = staged(nodes.join(holds, "key").filter(f"shared > ({percent} * n + 99) div 100 div 20").drop("shared"), "live")
    sets = staged(sets_of(source, live.select("node", "rep", "code", "key")), "sets")

    buckets = live.select("node", F.posexplode("marks").alias("i", "mark")).select("node", F.xxhash64("i", "mark").alias("bucket"))
    united = linked_components(live, buckets, sets, percent)

    first = united.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_key = nodes.select("node", "key", "rep").join(united, "node", "left").join(first, "component", "left").select(
        "key", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "key").join(of_key, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
