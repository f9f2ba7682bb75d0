"""Repeated passages by a sparse suffix array.

A window of ``LENGTH`` words has one minimiser: the position of the word run (``GRAM`` words) with the
least hash in it. Only suffixes that start at a minimiser of some window are retained, about one in
twenty, and the choice depends on content alone, so equal passages retain suffixes at equal places.

1. Retained suffixes are sorted by their first ``GRAM`` words; those without an equal neighbour go.
   Documents with equal words count once here, so large groups of copies stay small.
2. Around each suffix that is left, the match is extended to the left and right: every window that has
   it as its minimiser is compared with its neighbours in the order of whole windows.
3. In each document, windows with an equal neighbour run together into maximal passages.

The order is that of 64-bit hashes: Spark sorts and merges inside hash partitions, and counts of equal
neighbours are partial aggregates, so a passage held by a third of all documents makes no large task.
Windows count as equal where 96 bits of two hashes agree, of which the second is taken over other word
hashes: 1e13 windows have 1e-3 wrong pairs to expect. A word is in a passage if and only if one of the
windows around it occurs at two places or more.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import GOLDEN, by_chunk, free, give_back, grams, hashed, mix, split, staged, words

LENGTH, GRAM = 50, 8
#: characters that a worker handles at once, as each word makes a window of 25 bytes, and documents whose windows it merges at once
CHARS, MERGED = 1_000_000, 100


def minimisers(tokens: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word run, and the run that is each window's minimiser (the leftmost of the least)."""
    runs = grams(tokens, gram)
    view = np.lib.stride_tricks.sliding_window_view(runs, length - gram + 1)
    return runs, view.argmin(axis=1) + np.arange(len(view))


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_key, n_words, key, runs, places) of each document of ``length`` words at least."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, sizes, keys, runs, places = [], [], [], [], []
        for row, text in enumerate(part.column("text").to_pylist()):
            tokens = words(text)
            if len(tokens) < length:
                continue
            own = hashed(tokens)
            hashes, at = minimisers(own, length, gram)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            rows.append(row)
            sizes.append(len(tokens))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            runs.append(hashes[at].view(np.int64))
            places.append(at.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*(part.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_key")), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()),
             pa.array(runs, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            ["doc_id", "text_key", "n_words", "key", "runs", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(by_chunk(run, most=CHARS), f"doc_id {kind}, text_key long, n_words int, key binary, runs array<long>, places array<int>")


def second_hash(tokens: np.ndarray, length: int) -> np.ndarray:
    """32 bits of each run of ``length`` words: a polynomial over remixed word hashes, apart from ``grams``."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(length, np.uint64(0xD1342543DE82EF95)))[::-1]
        own = mix(tokens ^ GOLDEN)
        return (mix(np.convolve(own, power[::-1], "valid")) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def windows_at(docs: DataFrame, kept: DataFrame, length: int, gram: int) -> DataFrame:
    """(window, second, content, start, again) of the windows whose minimiser is in ``kept`` (content, rep, rep_key, key, again, places).

    ``again`` marks contents of which the same row may come more than once.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        content, window, second, start, again = [], [], [], [], []
        for text, key, number, more, places in zip(*(part.column(c).to_pylist() for c in ("text", "key", "content", "again", "places"))):
            own = hashed(words(text))
            if len(own) < length or xxhash.xxh3_128_digest(own.tobytes()) != key:
                continue
            _, at = minimisers(own, length, gram)
            here = np.flatnonzero(np.isin(at, places))
            window.append(grams(own, length)[here].view(np.int64))
            second.append(second_hash(own, length)[here])
            start.append(here.astype(np.int32))
            content.append(np.full(len(here), number))
            again.append(np.full(len(here), more))
        columns = ((window, pa.int64()), (second, pa.int32()), (content, pa.int64()), (start, pa.int32()), (again, pa.bool_()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else [], t) for x, t in columns], ["window", "second", "content", "start", "again"])

    same = docs["doc_id"].eqNullSafe(kept["rep"]) & (docs["text_key"] == kept["rep_key"])
    texts = docs.join(kept, same).select("text", "key", "content", "again", "places")
    return texts.mapInArrow(by_chunk(run, most=CHARS), "window long, second int, content long, start int, again boolean")


def _cover(starts: np.ndarray, length: int) -> np.ndarray:
    """Which words the windows at the marked starts cover."""
    edge = np.zeros(len(starts) + length, np.int32)
    edge[:len(starts)] += starts
    edge[length:] -= starts
    return np.cumsum(edge)[:-1] > 0


def _runs(state: np.ndarray) -> list[tuple[int, int, bool]]:
    """Runs of equal state 1 (kept) or 2 (removed) as (start, end, removed)."""
    cut = np.flatnonzero(np.diff(state)) + 1
    edges = [0, *cut.tolist(), len(state)]
    return [(a, b, bool(state[a] == 2)) for a, b in zip(edges[:-1], edges[1:]) if b > a and state[a]]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Passages of ``length`` words or more that occur more than once: (doc_id, start, end, n_words, removed).

    Words are runs of other than white space, A-Z lower-cased, counted from 0; ``end`` is exclusive.
    Of each repeated window the occurrence with the smallest doc_id, then the smallest start, is kept;
    words of other occurrences are ``removed`` unless a kept one needs them. A document without
    repeated passage gives no row; nor do null, empty and short texts. Rows with equal id and text
    are one document. Null ids count as larger than all others.
    """
    return _repeats(docs, id_col, text_col, length, gram).drop("text_key")


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """As ``repeats``, with the hash of the whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = staged(sampled(source, length, gram), "sampled")
    contents = staged(rows.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("x"), F.first("n_words").alias("n_words"), F.first("runs").alias("runs"),
        F.first("places").alias("places"),
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("copies"), F.count("*").alias("n"),
    ).orderBy("x", "key").select(  # contents are numbered in the order of their ids, null ids by their hashes
        F.monotonically_increasing_id().alias("content"), "key", F.col("x.doc_id").alias("rep"), F.col("x.text_key").alias("rep_key"), "n_words", "copies",
        (F.col("n") > F.col("copies")).alias("again"), "runs", "places"), "contents")
    suffixes = contents.select("content", F.explode(F.arrays_zip("runs", "places")).alias("x")).select(
        "content", F.col("x.runs").alias("run"), F.col("x.places").alias("place"))
    equal = suffixes.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run")
    left = suffixes.join(equal, "run").groupBy("content").agg(F.collect_list("place").alias("places"))
    kept = left.join(contents.select("content", "rep", "rep_key", "key", "again"), "content")
    made = staged(windows_at(source, kept, length, gram), "windows")
    windows = made.filter("NOT again").unionByName(made.filter("again").dropDuplicates(["content", "start"]))

    # the first content of each window that has an equal neighbour; ``own`` tells windows of it apart
    first = windows.groupBy("window", "second").agg(F.count("*").alias("n"), F.min("content").alias("c")).filter("n > 1")
    found = windows.join(first.select("window", "second", "c"), ["window", "second"]).select(
        "content", F.struct("start", F.when(F.col("content") == F.col("c"), F.col("window")).alias("own")).alias("x"))
    by_content = contents.select("content", "key", "rep", "n_words", "copies").join(
        found.groupBy("content").agg(F.collect_list("x").alias("x")), "content", "left").filter("copies > 1 or x is not null")

    def merge(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, out = [], []
        for key, size, copies, hits in zip(*(part.column(c).to_pylist() for c in ("key", "n_words", "copies", "x"))):
            first, other = np.zeros(size - length + 1, bool), np.zeros(size - length + 1, bool)
            seen = set()
            for at, own in sorted(((hit["start"], hit["own"]) for hit in hits or []), key=lambda x: x[0]):
                (other if own is None or own in seen else first)[at] = True
                seen.add(own)
            if copies > 1:  # what no other content holds earlier is first here
                first = ~other
            state = np.where(_cover(first, length), 1, np.where(_cover(other, length), 2, 0))
            keys.append(key)
            out.append([{"start": a, "end": b, "removed": r} for a, b, r in _runs(state)])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.list_(span))], ["key", "spans"])

    def batches(parts):
        for part in parts:
            for at in range(0, part.num_rows, MERGED):
                yield merge(part.slice(at, MERGED))
        give_back()

    spans = by_content.select("key", "n_words", "copies", "x").mapInArrow(
        batches, "key binary, spans array<struct<start: int, end: int, removed: boolean>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"), F.lit(True).alias("removed")))
    reps = by_content.select("key", "rep").join(spans, "key")
    out = rows.select("doc_id", "text_key", "n_words", "key").distinct().join(reps, "key").select(
        "doc_id", "text_key", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("rep")), F.col("spans")).otherwise(whole)).alias("x"))
    return out.select("doc_id", "text_key", "x.start", "x.end", (F.col("x.end") - F.col("x.start")).alias("n_words"), "x.removed")


_WORD = re.compile("[^\x20\x09-\x0d]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; a cut leaves the white space before it."""
    found = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:found[start][0]])
        at = found[end][0] if end < len(found) else len(text)
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut from their texts; all columns stay.

    A document of which nothing but white space is left goes; one without cut stays as it is, null
    and empty texts too.
    """
    one, two, cuts = free(docs, "_id"), free(docs, "_key"), free(docs, "_spans")
    removed = staged(_repeats(docs, id_col, text_col, length, GRAM).filter("removed").groupBy(
        F.col("doc_id").alias(one), F.col("text_key").alias(two)).agg(
            F.collect_list(F.struct("start", "end")).alias(cuts)), "removed")
    near, far = split(docs, F.xxhash64(text_col), removed.select(F.col(two).alias("code")))  # only texts that may be cut are shuffled
    same = F.col(id_col).eqNullSafe(F.col(one)) & (F.xxhash64(text_col) == F.col(two))
    joined = near.join(removed, same, "left").drop(one, two)
    names = docs.columns

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = part.column(cuts).to_pylist()
        part = part.select(names)
        if not any(spans):
            return part
        texts = part.column(text_col).to_pylist()
        keep = []
        for i, own in enumerate(spans):
            if own and texts[i] is not None:
                texts[i] = cut_words(texts[i], [(x["start"], x["end"]) for x in own])
            keep.append(not own or bool((texts[i] or "").strip()))
        at = names.index(text_col)
        return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type)).filter(pa.array(keep))

    return joined.mapInArrow(by_chunk(run, text_col), docs.schema).unionByName(far)
