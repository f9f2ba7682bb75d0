"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Every passage of every document is a query: ``PASSAGE`` words, a new one each ``STRIDE`` words. Test
items are indexed in segments of at most ``STRIDE`` words, so each copied segment lies whole in some
passage. An impact is a BM25 weight divided by the segment's total, so a score is the share of a
segment's weight that a passage holds, and all segments with a score of ``THRESHOLD`` or more are
retrieved.

Postings are cut into blocks of segments with the largest impact of each block. A first step bounds
the scores of a whole batch of passages from these maxima at once: terms found in many segments count
with their largest possible sum, the others are added up per passage and block. Passages with a block
that may reach the threshold go to WAND, which moves term cursors from pivot to pivot and skips blocks
by their maxima. Both bounds are exact: no segment above the threshold is missed.

A retrieved item is confirmed if enough of the word triples of its question and of its answer stand
near the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import by_chunk, free, staged

PASSAGE, STRIDE, BLOCK = 96, 48, 8
THRESHOLD, OVERLAP = 0.6, 0.5
K1, B = 1.2, 0.75
#: characters of test items in one index; a larger benchmark gets several, one pass each
INDEX_CHARS = 4_000_000

_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"\b(?:answer|solution)\s*[:=]|(?:^|\n)\s*A\s*[:.)]", re.IGNORECASE)


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of both parts; without an answer mark the last third is the answer."""
    mark = list(_ANSWER.finditer(text))
    if mark:
        question, answer = terms(text[:mark[-1].start()]), terms(text[mark[-1].end():])
        if question and answer:
            return question, answer
    own = terms(text)
    cut = -(-2 * len(own) // 3)
    return own[:cut], own[cut:]


def triples(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(tokens))
    return {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def overlap(part: list[str], near: list[str]) -> float:
    """Share of the part's word triples that occur in ``near``; 1 for an empty part."""
    want = triples(part)
    if not want:
        return 1.0
    n = min(3, len(part))
    return len(want & {tuple(near[i:i + n]) for i in range(len(near) - n + 1)}) / len(want)


@dataclass
class Index:
    items: list[tuple[str, list[str], list[str]]]  # item_key, question, answer
    item_of: list[int]  # of each segment
    number: dict[str, int]  # term -> number
    postings: list[tuple[list[int], list[float]]]  # of each term: segments, impacts
    top: np.ndarray  # largest impact of each term
    blocks: int
    block_max: list[dict[int, float]]  # of each term: block -> largest impact
    common: np.ndarray  # terms that are bounded together
    common_bound: np.ndarray  # of each block
    starts: np.ndarray  # rare terms' blocks, by term
    block_of: np.ndarray
    bound: np.ndarray


def build(items: list[tuple[str, str]], threshold: float) -> Index:
    """The index of (item_key, text) rows."""
    own, segments, item_of = [], [], []
    for item, text in items:
        tokens = terms(text)
        if not tokens:
            continue
        parts = -(-len(tokens) // STRIDE)
        for p in range(parts):
            segments.append(tokens[p * len(tokens) // parts:(p + 1) * len(tokens) // parts])
            item_of.append(len(own))
        own.append((item, *question_and_answer(text)))
    df = Counter(t for s in segments for t in set(s))
    number = {t: i for i, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}  # common terms first
    mean = sum(map(len, segments)) / max(1, len(segments))
    postings: list[tuple[list[int], list[float]]] = [([], []) for _ in number]
    block_max: list[dict[int, float]] = [{} for _ in number]
    for at, segment in enumerate(segments):
        weight = {t: math.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1)
                  / (n + K1 * (1 - B + B * len(segment) / mean)) for t, n in Counter(segment).items()}
        total = sum(weight.values())
        for t, w in weight.items():
            segs, impacts = postings[number[t]]
            segs.append(at)
            impacts.append(w / total)
            maxima = block_max[number[t]]
            maxima[at // BLOCK] = max(maxima.get(at // BLOCK, 0.0), w / total)
    blocks = -(-len(segments) // BLOCK)
    # the most frequent terms, as long as none of the segments gets half the threshold from them
    sums, n_common = np.zeros(len(segments)), 0
    for segs, impacts in postings:
        after = sums.copy()
        after[segs] += impacts
        if len(segs) < 4 or after.max() >= threshold / 2:
            break
        sums, n_common = after, n_common + 1
    rare = [sorted(block_max[t].items()) if t >= n_common else [] for t in range(len(number))]
    return Index(
        own, item_of, number, postings, np.array([max(w) for _, w in postings]), blocks, block_max,
        np.arange(len(number)) < n_common,
        np.array([sums[b * BLOCK:(b + 1) * BLOCK].max() for b in range(blocks)]),
        np.cumsum([0, *map(len, rare)]), np.array([b for r in rare for b, _ in r], np.int64),
        np.array([w for r in rare for _, w in r]))


def wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """(segment, score) of all segments with at least ``threshold``."""
    floor = threshold - 1e-9
    cursors = [[index.postings[t][0][0], 0, t] for t in query]  # current segment, position, term
    out = []

    def move(cursor: list[int], to: int) -> None:
        segs = index.postings[cursor[2]][0]
        cursor[1] = bisect_left(segs, to, cursor[1])
        cursor[0] = segs[cursor[1]] if cursor[1] < len(segs) else -1

    while True:
        cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort()
        bound, pivot = 0.0, None
        for i, c in enumerate(cursors):
            bound += index.top[c[2]]
            if bound >= floor:
                pivot = i
                break
        if pivot is None:
            return out
        segment = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == segment:
            pivot += 1
        block = segment // BLOCK
        if sum([index.block_max[c[2]].get(block, 0.0) for c in cursors[:pivot + 1]]) < floor:
            after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            to = int(min((block + 1) * BLOCK, after))
            for c in cursors[:pivot + 1]:
                move(c, max(to, segment + 1) if to <= segment else to)
            continue
        if cursors[0][0] == segment:
            score = sum([index.postings[c[2]][1][c[1]] for c in cursors[:pivot + 1]])
            if score >= floor:
                out.append((segment, score))
            for c in cursors[:pivot + 1]:
                move(c, segment + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < segment:
                    move(c, segment)


def candidates(index: Index, docs: list[np.ndarray], threshold: float) -> list[tuple[int, int, list[int]]]:
    """(document, passage, its terms) of the passages with a block that may reach the threshold."""
    passages = np.array([max(1, -(-len(d) // STRIDE)) for d in docs])
    base = np.concatenate([[0], np.cumsum(passages)])
    place = np.concatenate([np.arange(len(d)) // STRIDE + base[i] for i, d in enumerate(docs)] or [np.empty(0, np.int64)])
    first = np.repeat(base[:-1], [len(d) for d in docs])
    term = np.concatenate(docs) if docs else np.empty(0, np.int64)
    known = term >= 0
    place, first, term = place[known], first[known], term[known]
    inner = place > first  # words of a stride stand in the passage before as well
    size = len(index.number)
    pairs = np.unique(np.concatenate([place * size + term, (place[inner] - 1) * size + term[inner]]))
    passage, term = pairs // size, pairs % size
    rare = ~index.common[term]
    lengths = index.starts[term[rare] + 1] - index.starts[term[rare]]
    at = np.repeat(index.starts[term[rare]] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    slot = np.repeat(passage[rare], lengths) * index.blocks + index.block_of[at]
    # only blocks that some rare term of the passage reaches; common terms alone stay below the threshold
    slots, inverse = np.unique(slot, return_inverse=True)
    sums = np.bincount(inverse, index.bound[at], len(slots)) + index.common_bound[slots % index.blocks]
    hit = np.unique(slots[sums >= threshold - 1e-9] // index.blocks)
    low, high = np.searchsorted(passage, hit), np.searchsorted(passage, hit, "right")
    owner = np.searchsorted(base, hit, "right") - 1
    return [(int(o), int(h - base[o]), term[a:b].tolist()) for o, h, a, b in zip(owner, hit, low, high)]


def search(index: Index, texts: list[str | None], threshold: float, least: float) -> list[tuple]:
    """(row, item_key, score, question_overlap, answer_overlap, start) of confirmed items, best passage each."""
    number = index.number.get
    tokens = [terms(t) for t in texts]
    docs = [np.fromiter((number(w, -1) for w in own), np.int64, len(own)) for own in tokens]
    best: dict[tuple[int, int], tuple] = {}
    for row, passage, query in candidates(index, docs, threshold):
        for segment, score in wand(index, query, threshold):
            at = index.item_of[segment]
            item, question, answer = index.items[at]
            reach = len(question) + len(answer)
            start = passage * STRIDE
            near = tokens[row][max(0, start - reach):start + PASSAGE + reach]
            shares = overlap(question, near), overlap(answer, near)
            if min(shares) >= least and (score, -start) > best.get((row, at), ((-1.0, 0),))[0]:
                best[row, at] = ((score, -start), (row, item, score, *shares, start))
    return [x[1] for x in best.values()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                 least: float = OVERLAP) -> DataFrame:
    """Test items found in documents: (doc_id, item_id, score, question_overlap, answer_overlap, start_word).

    One row for each document and item, from its best passage. Words are runs of word characters in
    lower case. A document or item without words gives no row; clean documents give none. Repeated
    rows and null ids are searched like others; repeated items give repeated rows. ``start_word`` is
    the passage's first word.
    """
    items = benchmark.select(F.md5(item_text_col).alias("item_key"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(
        F.length("text") > 0)
    found = _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, threshold, least)
    return found.join(items.select("item_key", "item_id"), "item_key").select(
        "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word")


def _found(source: DataFrame, items: DataFrame, threshold: float, least: float) -> DataFrame:
    """Distinct item texts (item_key, text) found in ``source`` (doc_id, text), stored part by part of the items.

    The driver and a worker hold the index of one part, ``INDEX_CHARS`` characters and what their hashes deal unevenly.
    """
    items = items.select("item_key", "text").dropDuplicates(["item_key"])
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // INDEX_CHARS))
    schema = (f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_key string, score double, question_overlap double, "
              "answer_overlap double, start_word int")
    done = []
    for part in range(parts):  # one unless the benchmark is larger than INDEX_CHARS
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_key").collect()
        index = source.sparkSession.sparkContext.broadcast(build([(r["item_key"], r["text"]) for r in own], threshold))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows = search(index.value, batch.column("text").to_pylist(), threshold, least) if index.value.items else []
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(columns[0], pa.int64())), "item_key": pa.array(columns[1], pa.string()),
                "score": pa.array(columns[2], pa.float64()), "question_overlap": pa.array(columns[3], pa.float64()),
                "answer_overlap": pa.array(columns[4], pa.float64()), "start_word": pa.array(columns[5], pa.int32())})

        done.append(staged(source.mapInArrow(by_chunk(run), schema), "leaks"))
        index.destroy()
    return reduce(DataFrame.unionByName, done)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those in which a test item was found; all columns stay, null ids and texts too."""
    key = free(docs, "_md5")
    items = benchmark.select(F.md5(item_text_col).alias("item_key"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    found = _found(docs.select(F.md5(text_col).alias("doc_id"), F.col(text_col).alias("text")), items, THRESHOLD, OVERLAP)
    found = staged(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(found, F.md5(F.col(text_col)) == F.col(key), "left_anti")
