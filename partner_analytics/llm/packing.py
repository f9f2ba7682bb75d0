"""Best-fit packing of token sequences by a grouping genetic algorithm on distributed islands.

A gene is a whole sequence (a bin), not a document. Crossover injects the well-filled bins of one
parent into the other, drops the bins that now hold a piece twice and a few poorly filled ones, and
places the displaced pieces: first where one or two of them fill a bin better than one or two that
lie there, then by best fit. An island ends at a lower bound of its bins, or after as many crossovers
without gain as it has bins, ``PATIENCE`` at least. Pieces are dealt to shards of a bounded size; each shard evolves on several islands, each an
ordinary group of a Spark shuffle. Between epochs the elite of an island migrates to the next one.
Afterwards the pieces of all poorly filled bins move to new shards and evolve once more, so that what
a shard could not fill is packed together with the rest of the others.

Only (key, length) rows take part; texts and ids stay where they are.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.llm.common import by_chunk, staged
from partner_analytics.llm.pieces import pieces, vocabulary

CAPACITY, END = 4096, 1
#: pieces a shard holds on average; islands of a shard; genomes of an island; least number of crossovers without gain at its end
SHARD, ISLANDS, POPULATION, PATIENCE = 2048, 2, 4, 100
#: bins filled less than this move to the last round
WELL_FILLED = 0.995

Genome = list[list[int]]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, each cut at ``capacity``."""
    end = np.asarray([END], "<u4").tobytes()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        tool = pieces(path)
        owner, piece, start, length, crc = [], [], [], [], []
        for row, text in enumerate(part.column("text").to_pylist()):
            ids = tool.ids_of(text) + end
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at:at + 4 * capacity]
                owner.append(row)
                piece.append(i)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(by_chunk(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: Genome, room: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin that takes it, else into a new one; changes ``bins``."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r)
    for item in items:
        at = bisect_left(open_bins, (size[item], -1))
        if at < len(open_bins):
            free, b = open_bins.pop(at)
            bins[b].append(item)
        else:
            free, b = capacity, len(bins)
            bins.append([item])
            room.append(capacity)
        free -= size[item]
        room[b] = free
        if free:
            insort(open_bins, (free, b))


def fill(bins: Genome, size: list[int]) -> list[int]:
    return [sum([size[i] for i in b]) for b in bins]


def fitness(bins: Genome, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling."""
    return -len(bins), sum(f * f for f in fill(bins, size)) / (capacity * capacity * max(1, len(bins)))


def lower_bound(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: for each least size, what is over half a bin leaves room for the middle sizes only in part."""
    own = np.sort(np.asarray(size, np.int64))
    if not len(own):
        return 0
    total = np.concatenate([[0], np.cumsum(own)])
    half = int(np.searchsorted(own, capacity // 2, "right"))  # sizes up to half a bin
    least = np.unique(np.concatenate([[0], own[:half]]))
    first = np.searchsorted(own, least, "left")  # middle sizes start here
    alone = np.maximum(np.searchsorted(own, capacity - least, "right"), half)  # nothing of a least size fits beside these
    large = len(own) - half
    room = (alone - half) * capacity - (total[alone] - total[half])
    return int((large + np.maximum(0, -(-(total[half] - total[first] - room) // capacity))).max())


def replace(bins: Genome, room: list[int], items: list[int], size: list[int]) -> list[int]:
    """What is left of ``items``, largest first, after one or two took the place of one or two in bins they fill better."""
    loose = sorted((size[i], i) for i in items)
    for b in sorted(range(len(bins)), key=lambda i: -room[i]):
        own, free = bins[b], room[b]
        if not free or not loose:
            break
        gain, leave, enter, tried = 0, (), (), set()
        for leaving in ([x, y] if y > x else [x] for x in range(len(own)) for y in range(x, len(own))):
            gone = sum([size[own[x]] for x in leaving])
            if gone in tried:
                continue  # equal pieces, as copies have
            tried.add(gone)
            at = bisect_left(loose, (gone + free + 1, -1)) - 1
            if at >= 0 and loose[at][0] - gone > gain:
                gain, leave, enter = loose[at][0] - gone, leaving, [at]
            low, high = 0, len(loose) - 1
            while low < high:
                more = loose[low][0] + loose[high][0] - gone
                if more > free:
                    high -= 1
                else:
                    if more > gain:
                        gain, leave, enter = more, leaving, [low, high]
                    low += 1
            if gain == free:
                break
        if gain:
            entering = [loose.pop(at)[1] for at in reversed(enter)]
            for x in leave:
                insort(loose, (size[own[x]], own[x]))
            bins[b] = [i for x, i in enumerate(own) if x not in leave] + entering
            room[b] = free - gain
    return [i for _, i in reversed(loose)]


def cross(a: Genome, b: Genome, size: list[int], capacity: int, draw: random.Random) -> Genome:
    """Bins of ``b`` from the better filled half go whole into ``a``."""
    full = sorted(zip(fill(b, size), range(len(b))), reverse=True)
    share = draw.random()
    taken = [b[i] for _, i in full[:max(1, len(full) // 2)] if draw.random() < share] or [b[full[0][1]]]
    inside = {i for own in taken for i in own}
    kept, displaced = [], []
    for own in a:
        if inside.isdisjoint(own):
            kept.append(own)
        else:
            displaced += [i for i in own if i not in inside]
    child = [list(own) for own in [*taken, *kept]]
    room = [capacity - f for f in fill(child, size)]
    poor = set(sorted(range(len(child)), key=lambda i: -room[i] * draw.random())[:draw.randint(1, 8)])
    displaced += [i for b in poor for i in child[b]]
    child, room = [own for b, own in enumerate(child) if b not in poor], [r for b, r in enumerate(room) if b not in poor]
    best_fit(child, room, replace(child, room, displaced, size), size, capacity)
    return child


def evolve(size: list[int], genomes: list[Genome], seed: int, capacity: int = CAPACITY,
           population: int = POPULATION, patience: int = PATIENCE) -> Genome:
    """The best genome once crossovers bring no more gain; the population starts with ``genomes``."""
    draw = random.Random(seed)
    least = lower_bound(size, capacity)
    order = sorted(range(len(size)), key=lambda i: -size[i])
    people = [(fitness(g, size, capacity), g) for g in genomes]
    while len(people) < population:
        bins: Genome = []
        # the first newcomer is plain best-fit decreasing, the others blur the order
        blur = 0 if not people else capacity // 8
        best_fit(bins, [], order if not blur else sorted(order, key=lambda i: -size[i] - draw.randrange(blur)), size, capacity)
        people.append((fitness(bins, size, capacity), bins))
        if len(bins) <= least:
            return bins
    people.sort(key=lambda p: p[0], reverse=True)
    idle = 0
    while -people[0][0][0] > least and idle < max(patience, -people[0][0][0]):
        first, second = draw.sample(range(len(people)), 2) if len(people) > 1 else (0, 0)
        child = cross(people[first][1], people[second][1], size, capacity, draw)
        found = fitness(child, size, capacity)
        # only a saved bin counts as a gain; filling more unevenly goes on for ever
        idle = 0 if found[0] > people[0][0][0] else idle + 1
        if found > people[-1][0] and all(found != f for f, _ in people):
            people[-1] = found, child
            people.sort(key=lambda p: p[0], reverse=True)
    return people[0][1]


STATE = "shard long, island int, key long, length long, bin int"


def epoch(state: DataFrame, capacity: int, number: int) -> DataFrame:
    """One epoch of every island: ``state`` holds its pieces, with the bins of its elite and of the migrant."""

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(x) for x in group)
        own = frame.drop_duplicates("key").sort_values(["length", "key"], ascending=False)
        key, size = own["key"].to_numpy(), own["length"].tolist()
        place = pd.Series(np.arange(len(key)), index=key)
        genomes = []
        for _, of_one in frame[frame["bin"] >= 0].groupby("origin"):
            at = place.loc[of_one["key"]].to_numpy()
            bins: dict[int, list[int]] = {}
            for item, b in zip(at.tolist(), of_one["bin"].tolist()):
                bins.setdefault(b, []).append(item)
            genomes.append(list(bins.values()))
        best = evolve(size, genomes, (shard * 64 + island) * 2 + number, capacity)
        where = np.empty(len(key), np.int32)
        for b, items in enumerate(best):
            where[items] = b
        return pd.DataFrame({"shard": shard, "island": np.int32(island), "key": key, "length": size, "bin": where})

    return state.groupBy("shard", "island").applyInPandas(run, STATE)


def pack_round(items: DataFrame, count: int, capacity: int, shard: int, islands: int, salt: int) -> DataFrame:
    """(shard, key, length, bin): the best island's bins of each shard of ``items`` (key, length)."""
    shards = max(1, -(-count // shard))
    start = items.select(
        F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(shards)).alias("shard"), "key", "length",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
    ).select("shard", "island", "key", "length", F.lit(-1).alias("bin"), F.col("island").alias("origin"))
    first = staged(epoch(start, capacity, 0), "epoch")
    stay = first.withColumn("origin", F.col("island"))
    moved = stay.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
    second = staged(epoch(stay.unionByName(moved) if islands > 1 else stay, capacity, 1), "epoch")
    bins = second.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    score = bins.groupBy("shard", "island").agg(
        F.count("*").alias("bins"), F.sum(F.pow(F.col("fill") / capacity, 2)).alias("even"))
    best = score.groupBy("shard").agg(F.min(F.struct("bins", -F.col("even"), "island")).alias("x")).select(
        "shard", F.col("x.island").alias("island"))
    return second.join(best, ["shard", "island"], "left_semi").drop("island")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """Packs the ids of all documents into sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the end id alone. Repeated rows and null ids are packed like all others. Documents
    longer than ``capacity`` are cut; their full pieces are sequences of their own.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = staged(cut_pieces(source, path or vocabulary(), capacity).select(
        F.monotonically_increasing_id().alias("key"), "*"), "pieces")
    full = parts.filter(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"))
    loose = parts.filter(F.col("length") < capacity).select("key", "length")
    first = staged(pack_round(loose, loose.count(), capacity, shard, islands, 0), "packed")
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    poor = fills.filter(F.col("fill") < WELL_FILLED * capacity).select("shard", "bin")
    again = staged(first.join(poor, ["shard", "bin"], "left_semi").select("key", "length"), "again")
    last = pack_round(again, again.count(), capacity, shard, islands, 1)

    def numbered(df: DataFrame, number: int) -> DataFrame:
        return df.select("key", (F.col("shard") * (1 << 24) + F.col("bin") * 2 + number).alias("sequence_id"))

    places = full.unionByName(numbered(first.join(poor, ["shard", "bin"], "left_anti"), 0)).unionByName(numbered(last, 1))
    before = Window.partitionBy("sequence_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(places, "key").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
