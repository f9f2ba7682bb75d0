"""The set join against all pairs."""

import random

import pytest
from test_duplicates import shingles

from partner_analytics.llm import clusters, set_join
from partner_analytics.llm.queries import QUERIES

DOCS = "doc_id long, text string, row long, own string, node int"


def brute(docs, percent=80):
    sets = [shingles(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, own in enumerate(sets):
        for y in range(x):
            shared = len(own & sets[y])
            if shared and 100 * shared >= percent * (len(own) + len(sets[y]) - shared):
                parent[find(x)] = find(y)
    least = {}
    for x, d in enumerate(docs):
        if d[0] is not None:
            least[find(x)] = min(d[0], least.get(find(x), d[0]))
    return sorted((d[0] if d[0] is not None else -1, len(s), least.get(find(x), -1)) for x, (d, s) in enumerate(zip(docs, sets)))


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def families(seed, groups, size, most):
    """Near copies at many distances round a base text, some longer or shorter, with a passage that many share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage, texts = draw.sample(vocabulary, 60), []
    for g in range(groups):
        base = draw.choices(vocabulary, k=draw.randrange(3, 140))
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(0, most + 1)):
                at = draw.randrange(len(own))
                own[at:at + draw.randrange(0, 2)] = [draw.choice(vocabulary[:40] + ["odd"])] * draw.randrange(0, 3) or ["x"]
            texts.append(" ".join(own + passage * (g % 3 == 0)))
    return texts


ODD = [None, "", " \t\n", "one", "ONE", "one two", "a b c d e", "A B C D E", "a b c d e f", "é à a b c", "É à a b c"]


@pytest.mark.parametrize("percent,compare", [(80, 256), (80, 3), (60, 256)])
def test_join_against_all_pairs(workers, monkeypatch, percent, compare):
    monkeypatch.setattr(clusters, "COMPARE", compare)
    texts = ODD + families(1, 14, 12, 4) + families(2, 3, 60, 3) + ["long " * 30_000, " ".join(map(str, range(20_000)))]
    docs = [(3 * i, t, i, "x", 1) for i, t in enumerate(texts)]
    docs += [(None, texts[20], 0, "x", 1), (None, None, 0, "x", 1), (None, "alone here with nothing else", 0, "x", 1), (33, texts[11], 0, "x", 1), (33, texts[90], 0, "x", 1)]
    random.Random(4).shuffle(docs)
    assert found(set_join.similar_sets(workers.createDataFrame(docs, DOCS), percent=percent)) == brute(docs, percent)


def test_join_without_clusters(workers, monkeypatch):
    """No centre at all: the blocked index alone finds every link."""
    monkeypatch.setattr(clusters, "gathered", lambda nodes, buckets: nodes.selectExpr("node", "node AS centre"))
    docs = [(i, t, i, "x", 1) for i, t in enumerate(ODD + families(3, 10, 14, 4))]
    assert found(set_join.similar_sets(workers.createDataFrame(docs, DOCS))) == brute(docs)


def test_join_of_empty_table(workers):
    assert set_join.similar_sets(workers.createDataFrame([], DOCS)).collect() == []
    assert found(set_join.similar_sets(workers.createDataFrame([(1, None, 1, "x", 1)], DOCS))) == [(1, 0, 1)]


def test_pairs_of_a_near_copy_group_stay_few(workers, monkeypatch):
    draw, counts = random.Random(9), []
    base = [f"b{i}" for i in range(100)]
    whole = clusters.compared
    monkeypatch.setattr(clusters, "compared", lambda pairs, *rest: (counts.append(pairs.count()), whole(pairs, *rest))[1])
    for n in (300, 1200):
        docs = []
        for i in range(n):
            own = list(base)
            for at in draw.sample(range(100), draw.randrange(1, 4)):
                own[at] = f"new{i} {at}"
            docs.append((i, " ".join(own), i, "x", 1))
        set_join.similar_sets(workers.createDataFrame(docs, DOCS)).count()
    assert counts[2] + counts[3] < 5 * (counts[0] + counts[1])


def test_join_query_against_all_pairs(workers, sf_dir):
    docs = [(r[0], r[1]) for r in workers.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_set_join"](workers, sf_dir)) == brute(docs)


def test_sets_with_a_common_phrase_alone_leave_the_search(spark):
    """A phrase that all sets hold joins none of them; the one pair that links stays and is found."""
    import numpy as np

    from partner_analytics.llm.clusters import across_clusters, mixed, still_open

    draw = np.random.default_rng(3)
    own = [np.concatenate([np.arange(15), draw.integers(100, 2 ** 62, 85)]) for _ in range(40)]
    own[1] = np.concatenate([own[0][:90], draw.integers(100, 2 ** 62, 10)])
    sets = spark.createDataFrame([(i, np.sort(x).tobytes()) for i, x in enumerate(own)], "node long, own binary")
    nodes = spark.createDataFrame([(i, 100, i, i) for i in range(40)], "node long, n long, component long, cluster long")
    assert {r.node for r in still_open(nodes, sets, 75, ["component", "cluster"]).collect()} == {0, 1}
    assert [tuple(r) for r in across_clusters(nodes, sets, 75).collect()] == [(1, 0)]

    placed = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (2, 1, 7), (2, 2, 8), (3, 1, 7), (3, 1, 8)], "bucket long, component long, cluster long")
    assert [r.bucket for r in mixed(placed, "component", "cluster").collect()] == [2]


def test_a_phrase_of_many_sets_stands_last_in_prefixes(spark):
    """Sets that have only a common phrase with others show none of it among their first elements."""
    import numpy as np

    from partner_analytics.llm.clusters import common_elements, first_elements

    phrase = np.arange(5, dtype=np.int64)  # first in hash order
    rows = [(i, np.sort(np.concatenate([phrase, 1000 + 100 * i + np.arange(60, dtype=np.int64)])).tobytes()) for i in range(400)]
    sets = spark.createDataFrame([(i, bytearray(own)) for i, own in rows], "node long, own binary")
    late = common_elements(sets)
    assert set(late) == set(phrase)
    first = first_elements(sets, 75, 20, late)
    assert first.filter("element < 5").count() == 0 and first.groupBy("node").count().select("count").distinct().count() == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_first_elements_of_a_chunk_go_as_one_row_a_part(workers, parts):
    """Counts are those over all pairs of different texts, copies counted once, and few rows are shuffled for them."""
    from collections import Counter

    from pyspark.sql import functions as F

    from partner_analytics.llm.shingles import shingle_set

    texts = families(5, 12, 6, 4) + ODD
    docs = workers.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:20]])], "doc_id long, text string").repartition(5).withColumn(
        "code", F.xxhash64("text"))
    lists = {}
    for r in docs.select("code", "text").distinct().collect():
        own = shingle_set(r.text)
        lists[r.code] = set(own[:set_join._longer_prefix(len(own), 80)].tolist())
    held = Counter(x for own in lists.values() for x in own)
    right = {c: n for c, own in lists.items() if (n := sum(held[x] > 1 for x in own))}
    found = set_join.shared_counts(docs, 80, parts)
    counted = {r.code: r.n for r in found.collect()}
    assert all(counted.get(c, 0) >= n for c, n in right.items())
    exact = {r.code: r.n for r in set_join.shared_counts(docs.dropDuplicates(["code"]).coalesce(1), 80, parts).collect()}
    assert exact == right
    sent = [x for x in str(found._jdf.queryExecution().executedPlan()).splitlines() if "Exchange" in x]
    assert any("part" in x for x in sent) and not any("element" in x and "elements" not in x for x in sent)


def test_sets_not_sought_are_not_shuffled(workers):
    """A large table of sets is cut to those of the nodes before a join, up to a few that share a bit."""
    sets = workers.range(20_000).selectExpr("id AS node", "encode(cast(id AS string), 'UTF-8') AS own")
    left = {r.node for r in clusters.of_nodes(sets, workers.createDataFrame([(7,), (7,), (19_999,)], "node long")).collect()}
    assert {7, 19_999} <= left and len(left) < 50


def test_one_text_of_each_set_is_picked(workers):
    """Copies by the thousand, a null id and a repeated row give one set for each node."""
    import xxhash
    from pyspark.sql import functions as F

    from partner_analytics.llm.shingles import shingle_set

    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = workers.createDataFrame([(3, a), (3, a), (None, b), *[(i, a) for i in range(4, 300)]], "doc_id long, text string").withColumn("code", F.xxhash64("text"))
    key = {t: xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in (a, b)}
    nodes = workers.createDataFrame([(0, 3, a, bytearray(key[a])), (1, None, b, bytearray(key[b]))], "node long, rep long, text string, key binary").select(
        "node", "rep", F.xxhash64("text").alias("code"), "key")
    found = {r.node: bytes(r.own) for r in clusters.sets_of(docs, nodes).collect()}
    assert found == {0: shingle_set(a).tobytes(), 1: shingle_set(b).tobytes()}
    assert clusters.sets_of(docs, nodes).count() == 2
