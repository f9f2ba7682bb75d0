"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of zero to ``ORDER`` words. A context keeps a next word of its own if the
pair occurs ``LEAST`` times, at every size of the corpus. It is retained where its next words differ
enough from those of its longest retained suffix: count * divergence >= half a logarithm of the count
for each kept word.

A retained context gives a kept word its discounted share plus the discounted mass times the shorter
context's probability, any other word the latter alone; the root is the smoothed word frequency. So
every distribution sums to one, and a text's score is its root score plus one addend for each run of
words (gram) in it: the logarithm of the mass that a retained context leaves, and for a kept pair what its
probability adds to that. Counts, contexts and addends are tables dealt by 64-bit hashes of the grams;
only the most frequent ones (``NEAR``; a bounded number) are looked up without a shuffle, as are
frequent words (``HOT``). Words are counted by their bytes and looked up by a 64-bit hash.

Grams move as packed arrays, one row for each chunk of texts and part of the hashes. They are counted in
``PASSES`` over the texts, each for the hashes of one remainder, and texts are scored in ``ROUNDS``, each
for the rows of one remainder; what a pass or a round shuffles is freed before the next.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import GOLDEN, by_chunk, chunks, forget, give_back, id_bucket, mix, staged, words

ORDER, LEAST, NEAR, HOT, DISCOUNT = 2, 2, 1_000_000, 1e-6, 0.75
#: passes over the texts that count grams, and rounds that score texts; each shuffles its share of them
PASSES, ROUNDS = 3, 3
#: grams that one part of a pass or round holds
PART_GRAMS = 500_000
#: characters of text that a worker scores at once
CODE_CHARS = 2_000_000
#: the end of a text; no word is empty
END = b""
#: distinct words a worker adds up before it passes them on
FLUSH = 300_000
#: the first 0 to 8 bytes of eight
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: bytes with A-Z lower-cased and all that parts words as a space
PLAIN = np.frombuffer(bytes(range(256)).lower().translate(bytes(32 if bytes([i]).isspace() else i for i in range(256))), np.uint8)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, one end for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in chunks(batch):
                for text in part.column("text").to_pylist():
                    total.update(words(text))
                total[END] += part.num_rows
                if len(total) >= FLUSH:
                    yield out()
                    total.clear()
        if total:
            yield out()
            total.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def hashes_at(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of some bytes, eight bytes at a time."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = end - begin
    with np.errstate(over="ignore"):
        value = mix(size.astype(np.uint64) * GOLDEN + (eights[begin] & FIRST[np.minimum(size, 8)]))
        done, open_ = 8, np.flatnonzero(size > 8)
        while len(open_):
            eight = eights[begin[open_] + done] & FIRST[np.minimum(size[open_] - done, 8)]
            value[open_] = mix(value[open_] * GOLDEN + eight)
            done += 8
            open_ = open_[size[open_] > done]
    return value


def hashed(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    end = np.cumsum(np.array([len(x) for x in tokens], np.int64))
    return hashes_at(np.frombuffer(b"".join(tokens), np.uint8), np.append(0, end[:-1])[:len(tokens)], end)


def words_at(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, begin, end, n): the bytes of all texts, lower-cased, where ``words`` of them stand, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = PLAIN[np.frombuffer(raw, np.uint8)[edge[0]:edge[-1]]] if raw else np.empty(0, np.uint8)
    edge = edge - edge[0]
    inner = np.concatenate([[False], data != 32, [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    # a word begins, or ends, where one side is no word or another text
    begin = np.flatnonzero(inner[1:] & (~inner[:-1] | cut))
    end = np.flatnonzero(inner[:-1] & (~inner[1:] | cut))
    return data, begin, end, np.diff(np.searchsorted(begin, edge))


def grams_of(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(start, grams, at) of texts by the hashes and numbers of their words: where each text begins; hashes of all
    runs of 1 to ORDER + 1 words, the end of a text among them, and their last token."""
    length = n + 1
    start = np.cumsum(length) - length
    own = np.full(length.sum(), hashed([END])[0], np.uint64)
    own[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
    grams, at = [own], [np.arange(len(own))]
    place = at[0] - np.repeat(start, length)
    for k in range(1, ORDER + 1):
        longer = np.flatnonzero(place[at[-1]] >= k)
        grams.append(joined(grams[-1][longer - 1], grams[-1][longer]))
        at.append(at[-1][longer])
    return start, grams, at


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the run that begins with ``prefix`` and ends with ``suffix``, each one word shorter."""
    with np.errstate(over="ignore"):
        return mix(mix(prefix * GOLDEN + np.uint64(1)) + suffix)


def firsts(values: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array stands first."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def parts_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hashes that each gram falls into; it rises with the gram."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.min_scalar_type(parts))


def dealt(to: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part of sorted ones, and where it stands."""
    edge = np.append(firsts(to), len(to)).tolist()
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(to[a]), slice(a, b)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest takes."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def wide(data: bytes, count: int) -> np.ndarray:
    """``count`` numbers that ``narrow`` packed."""
    return np.frombuffer(data, f"u{len(data) // count}").astype(np.int64)


def gram_counts(docs: DataFrame, tokens: int) -> DataFrame:
    """(k, gram, prefix, suffix, n) of runs of 2 to ``ORDER`` + 1 words that occur ``LEAST`` times in texts of ``tokens`` words and ends."""
    parts = 1 + tokens // (PASSES * PART_GRAMS)
    names, kinds = ["part", "k", "prefix", "suffix", "n"], [pa.int32(), pa.int32(), *[pa.binary()] * 3]

    def sender(number: int):
        def send(part: pa.RecordBatch) -> pa.RecordBatch:
            data, begin, end, size = words_at(part.column("text"))
            _, grams, at = grams_of(hashes_at(data, begin, end), size)
            rows = []
            for k in range(2, ORDER + 2):
                own = np.flatnonzero(grams[k - 1] % np.uint64(PASSES) == number)
                own = own[np.argsort(grams[k - 1][own])]
                gram = grams[k - 1][own]
                first = firsts(gram)
                n = np.diff(np.append(first, len(gram)))
                shorter = np.zeros(len(grams[0]), np.uint64)
                shorter[at[k - 2]] = grams[k - 2]  # by last token
                last = at[k - 1][own[first]]
                prefix, suffix = shorter[last - 1], shorter[last]
                rows += [(to, k, prefix[x].tobytes(), suffix[x].tobytes(), narrow(n[x])) for to, x in dealt(parts_of(gram[first], parts))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

        return by_chunk(send)

    def add_up(table: pa.Table) -> pa.Table:
        """The counts that all chunks sent to one part."""
        prefix, suffix = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("prefix", "suffix"))
        n = np.concatenate([wide(x, len(p) // 8) for p, x in zip(table.column("prefix").to_pylist(), table.column("n").to_pylist())])
        gram = joined(prefix, suffix)
        order = np.argsort(gram)
        first = firsts(gram[order])
        give_back()
        n = np.add.reduceat(n[order], first)
        own = order[first[n >= LEAST]]
        columns = [x[own].view(np.int64) for x in (gram, prefix, suffix)]
        return pa.table([np.full(len(own), table.column("k")[0].as_py(), np.int32), *columns, n[n >= LEAST]], ["k", "gram", "prefix", "suffix", "n"])

    return reduce(DataFrame.unionByName, [
        staged(docs.select("text").mapInArrow(sender(i), "part int, k int, prefix binary, suffix binary, n binary").groupBy("part", "k").applyInArrow(
            add_up, "k int, gram long, prefix long, suffix long, n long"), "grams", once=True) for i in range(PASSES)])


def by_hash(table: DataFrame) -> DataFrame:
    """(gram, n) of ``table`` (word, n)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashed(part.column("word").to_pylist()).view(np.int64)), part.column("n")], ["gram", "n"])

    return table.mapInArrow(lambda parts: map(run, parts), "gram long, n long")


def addends(docs: DataFrame, table: DataFrame, base: float) -> list[DataFrame]:
    """(gram, n, delta) by length: what a retained context leaves to the shorter one, and what its kept pairs add to that."""

    shorter = staged(by_hash(table.filter(F.col("n") >= LEAST)).withColumn(
        "log", F.log10((F.col("n") + 0.5) / F.lit(base))), "level", once=True)
    grams = gram_counts(docs, table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    out = []
    for k in range(2, ORDER + 2):
        # a run's suffix and its context occur at least as often as it does, so the joins lose nothing
        low = shorter.select(F.col("gram").alias("suffix"), F.col("log").alias("low"))
        pairs = staged(grams.filter(F.col("k") == k).join(low, "suffix").select("gram", "prefix", "n", "low"), "pairs", once=True)
        n, a, total = F.col("n"), F.col("a"), F.col("total").cast("double")
        sums = pairs.groupBy("prefix").agg(
            F.count("*").alias("kept"), F.sum("n").alias("a"), F.sum(F.pow(F.lit(10.0), "low")).alias("c"),
            F.sum(n * (F.log(n.cast("double")) - F.col("low") * math.log(10))).alias("b"))
        own_rest, low_rest = F.greatest(1 - a / total, F.lit(0.0)), F.greatest(1 - F.col("c"), F.lit(1e-12))
        divergence = (F.col("b") - a * F.log(total)) / total + F.when(own_rest > 0, own_rest * F.log(own_rest / low_rest)).otherwise(0.0)
        contexts = staged(sums.join(shorter.select(F.col("gram").alias("prefix"), F.col("n").alias("total")), "prefix").filter(
            total * divergence >= 0.5 * (F.col("kept") + 1) * F.log(total + 1)).select(
                "prefix", "total", F.log10(F.greatest(1 - (a - DISCOUNT * F.col("kept")) / total, F.lit(1e-12))).alias("rest")), "contexts", once=True)
        if k == 2:
            forget(shorter)
        both = pairs.join(contexts, "prefix", "left")
        raised = F.log10((n - DISCOUNT) / F.col("total") + F.pow(F.lit(10.0), F.col("rest") + F.col("low")))
        delta = (raised - F.col("low") - F.col("rest")).alias("delta")
        if k == ORDER + 1:  # nothing is longer
            level = both.select("gram", "n", delta).filter("delta IS NOT NULL")
        else:
            level = both.select("gram", "n", F.coalesce(raised, "low").alias("log"), delta)
        shorter = staged(level, "level", once=True)
        forget(pairs)
        out += [contexts.select(F.col("prefix").alias("gram"), F.col("total").alias("n"), F.col("rest").alias("delta")),
                shorter.filter("delta IS NOT NULL").select("gram", "n", "delta")]
    forget(grams)
    return out


def packed(addends: list[DataFrame], roots: DataFrame, parts: int) -> DataFrame:
    """(part, grams, n, delta, root): one row for each part of the hashes, by gram; the addends (gram, n, delta) of one gram
    are added up, ``roots`` (gram, root) are what a word adds to the root score."""
    kinds = {"n": np.int64, "delta": np.float64, "root": np.float64}
    schema, names = "part int, grams binary, n binary, delta binary, root binary", ["part", "grams", *kinds]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(gram)
            gram, columns = gram[order], [table.column(c).to_numpy()[order] if c in table.column_names else None for c in kinds]
            rows = [(to, gram[x].tobytes(), *[b"" if c is None else c[x].tobytes() for c in columns]) for to, x in dealt(parts_of(gram, parts))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32(), *[pa.binary()] * 4])], names)

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PART_GRAMS:
                yield out()
                held.clear()
        if held:
            yield out()
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        n, delta, root = (np.concatenate([np.frombuffer(x, t) if x else np.zeros(len(g), t) for x, g in zip(table.column(c).to_pylist(), grams)])
                          for c, t in kinds.items())
        gram = np.concatenate(grams)
        order = np.argsort(gram)
        first = firsts(gram[order])
        row = [table.column("part")[0].as_py(), gram[order][first].tobytes(), np.maximum.reduceat(n[order], first).tobytes(),
               np.add.reduceat(delta[order], first).tobytes(), np.maximum.reduceat(root[order], first).tobytes()]
        give_back()
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 4))], names)

    sent = [reduce(DataFrame.unionByName, addends).select("gram", "n", "delta"), roots.select("gram", "root")]
    return reduce(DataFrame.unionByName, [x.mapInArrow(send, schema) for x in sent]).groupBy("part").applyInArrow(merge, schema)


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts: (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from the rows that ``learns`` marks. A null, empty or blank text is its end
    alone. Repeated rows count and are scored one by one, null ids like others. With nothing to learn
    from, N is 0 and V is 0, and both scores are those of the formula. Very long texts are scored whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), learns.alias("learns"))
    table = staged(word_counts(source.filter("learns")), "words")
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = total + 0.5 * (distinct + 1)
    often = (F.col("n") >= max(1, HOT * total)) | (F.octet_length("word") == 0)
    frequent = table.filter(often).toArrow()
    counts, names = frequent.column("n").to_numpy(), frequent.column("word").to_pylist()
    if END not in names:
        names, counts = [*names, END], np.append(counts, 0)
    name = hashed(names)
    order = np.argsort(name)
    known = spark.sparkContext.broadcast((name[order], np.log10((counts + 0.5) / base)[order], (counts > 0)[order]))

    # what each run of words adds to the score of a text, as a context and as a pair, and each other word to that of one never seen
    unseen = math.log10(0.5 / base)
    found = addends(source.filter("learns"), table, float(base))
    roots = by_hash(table.filter(~often)).select("gram", F.log10((F.col("n") + 0.5) / 0.5).alias("root"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + size // (3 * ROUNDS * PART_GRAMS)  # of a chunk's grams, about one in three bytes goes there
    tree = staged(packed(found, roots, parts), "tree", once=True)
    for each in [*found, table]:
        forget(each)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("n").to_pylist():
                n, grams = np.unique(np.frombuffer(n, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n[n > 0]), pa.array(grams[n > 0])], ["n", "grams"])

    # the most frequent grams, NEAR at most: from the least count that lets all of them in
    by_count = np.array([tuple(r) for r in tree.select("n").mapInArrow(tally, "n long, grams long").groupBy("n").agg(F.sum("grams")).collect()], np.int64).reshape(-1, 2)
    by_count = by_count[np.argsort(-by_count[:, 0])]
    fits = int(np.count_nonzero(np.cumsum(by_count[:, 1]) <= NEAR))
    whole, least = fits == len(by_count), int(by_count[fits - 1, 0]) if fits else 1 << 62

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *columns in zip(*(batch.column(c).to_pylist() for c in ("n", "grams", "delta", "root"))):
                own = np.frombuffer(n, np.int64) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, t)[own]) for x, t in zip(columns, (np.int64, float, float))], ["gram", "delta", "root"])

    taken = tree.mapInArrow(take, "gram long, delta double, root double").toArrow()
    gram = taken.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    near = spark.sparkContext.broadcast((gram[order], taken.column("delta").to_numpy()[order], taken.column("root").to_numpy()[order]))
    kind = source.schema["doc_id"].dataType.simpleString()
    texts_have = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    schema = f"part int, chunk long, row long, {texts_have}, keys binary, places binary"
    fields = ["part", "chunk", "row", "doc_id", "n_tokens", "n_known", "base_score", "score", "keys", "places"]

    def sums(of: np.ndarray, delta: np.ndarray, root: np.ndarray, n: int) -> np.ndarray:
        """What grams add to the scores, the root scores and the known words of ``n`` texts."""
        return np.stack([np.bincount(of, x, n).astype(float) for x in (delta, root, root > 0)])  # of none are whole numbers

    def code(part: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each text, and for each part of the hashes: grams that aren't near (keys), and the texts they are in (places)."""
        data, begin, end, n = words_at(part.column("text"))
        start, grams, last = grams_of(hashes_at(data, begin, end), n)
        owner = np.repeat(np.arange(len(n)), n + 1)
        word, log, seen = known.value
        table, delta, root = near.value
        row = part.column("row").to_numpy()
        asked, added = [], np.zeros((3, len(n)))
        for k, (values, at) in enumerate(zip(grams, last)):
            order = np.argsort(values)
            gram, of = values[order], owner[at[order]]
            place = find(table, gram)
            hit = place >= 0
            added += sums(of[hit], delta[place[hit]], root[place[hit]], len(n))
            ask = ~hit
            if k == 0:
                place = np.empty(len(order), np.int64)
                place[order] = find(word, gram)
                plain, sure = np.where(place >= 0, log[place], unseen), (place >= 0) & seen[place]
                ask &= (place[order] < 0) | (not whole)
            if k == 0 or not whole:
                asked.append((gram[ask], of[ask]))
        gram, of = map(np.concatenate, zip(*asked))
        to = parts_of(gram, parts)
        order = np.argsort(to, kind="stable")  # by length and gram in each part
        gram, of = gram[order], (row - row[0])[of[order]]
        rows = [(to, gram[x].tobytes(), narrow(of[x])) for to, x in dealt(to[order])]
        to, keys, places = zip(*rows) if rows else [[]] * 3
        base_score = np.add.reduceat(plain, start) + added[1]
        docs = [pa.array(row % parts, pa.int32()), pa.array(np.full(len(n), row[0])), part.column("row"), part.column("doc_id"), pa.array(n + 1),
                pa.array(np.add.reduceat(sure.astype(np.int64), start) + added[2].astype(np.int64)), pa.array(base_score), pa.array(base_score + added[0])]
        own = [pa.array(to, pa.int32()), pa.array(np.full(len(to), row[0])), *[pa.nulls(len(to), x.type) for x in docs[2:]]]
        docs += [pa.nulls(len(n), pa.binary())] * 2
        own += [pa.array(keys, pa.binary()), pa.array(places, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(docs, own)], fields)

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The rows of texts, and for each chunk what the grams of one part add (keys) to its texts (places)."""
        sent, texts = asked.filter(pc.is_null(asked.column("row"))), asked.filter(pc.is_valid(asked.column("row")))
        rows = []
        if sent.num_rows and held.num_rows:
            table, delta, root = (np.frombuffer(held.column(c)[0].as_py(), t) for c, t in (("grams", np.uint64), ("delta", float), ("root", float)))
            keys = sent.column("keys").to_pylist()
            place = find(table, np.frombuffer(b"".join(keys), np.uint64))
            hit = np.flatnonzero(place >= 0)
            # a text by its chunk's first row and its place in the chunk
            own = np.concatenate([wide(x, len(k) // 8) for k, x in zip(keys, sent.column("places").to_pylist())])[hit]
            own += np.repeat(sent.column("chunk").to_numpy(), [len(k) // 8 for k in keys])[hit]
            chunk = np.sort(sent.column("chunk").to_numpy())
            to, of = np.unique(own, return_inverse=True)
            total = sums(of, delta[place[hit]], root[place[hit]], len(to))
            first = chunk[np.searchsorted(chunk, to, "right") - 1] if len(to) else to
            rows = [(c, total[:, x].tobytes(), narrow(to[x] - c)) for c, x in dealt(first)]
        own = dict(zip(("chunk", "keys", "places"), zip(*rows) if rows else [[]] * 3))
        back = pa.table([pa.array(own[x.name], x.type) if x.name in own else pa.nulls(len(rows), x.type) for x in texts.schema], texts.schema)
        give_back()
        return pa.concat_tables([texts, back])

    def add_up(table: pa.Table) -> pa.Table:
        """The texts of one chunk, with what all parts add to them."""
        sent, texts = table.filter(pc.is_null(table.column("row"))), table.filter(pc.is_valid(table.column("row")))
        place = texts.column("row").to_numpy() - texts.column("chunk").to_numpy()
        added = np.zeros((3, place.max() + 1))
        for keys, places in zip(sent.column("keys").to_pylist(), sent.column("places").to_pylist()):
            added[:, wide(places, len(keys) // 24)] += np.frombuffer(keys).reshape(3, -1)
        deep, root, more = added[:, place]
        for name, x in (("n_known", more.astype(np.int64)), ("base_score", root), ("score", root + deep)):
            texts = texts.set_column(fields.index(name), name, pa.array(texts.column(name).to_numpy() + x))
        return texts.select(fields[3:8])

    def scored(number: int) -> DataFrame:
        own = source.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(ROUNDS)) == number)
        sent = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(by_chunk(code, most=CODE_CHARS), schema)
        back = sent.groupBy("part").cogroup(tree.drop("n").groupBy("part")).applyInArrow(look_up, schema)
        return staged(back.groupBy("chunk").applyInArrow(add_up, texts_have), "scores", once=True)

    scores = reduce(DataFrame.unionByName, [scored(i) for i in range(ROUNDS)])
    forget(tree)
    return scores.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def learns_from(id_column: Column) -> Column:
    """Rows whose crc32 of the id as text, modulo 5, is not 1."""
    return id_bucket(id_column, 5) != 1
