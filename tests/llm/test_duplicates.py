"""Near-duplicates, repeated passages, decontamination, language ID and the pipeline against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partner_analytics.llm import decontamination, graph, language_id, near_dedup, repeats
from partner_analytics.llm.queries import QUERIES


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    own = words(text)
    n = min(5, len(own))
    return frozenset(tuple(own[i:i + n]) for i in range(len(own) - n + 1)) if own else frozenset()


def brute_components(docs):
    """{doc_id: smallest id reachable} over all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            shared = len(a & b)
            if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(s), least.get(find(x)), i == least.get(find(x))) for x, (i, s) in enumerate(sets)]


def near_copies():
    """Families at many distances, a passage that all of one group share, exact copies, odd rows."""
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.sample(vocabulary, 40)
    docs = []
    for _ in range(12):
        base = draw.choices(vocabulary, k=draw.randrange(4, 150))
        for _ in range(8):
            own = list(base)
            for _ in range(draw.randrange(0, 1 + len(own) // 12)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            docs.append(" ".join(own))
    docs += [" ".join(passage + draw.choices(vocabulary, k=draw.randrange(3, 40))) for _ in range(60)]
    docs += docs[:20] + ["", " \n", "one", "ONE", "one two", "a a a a a a a a"]
    rows = list(zip(draw.sample(range(1000), len(docs)), docs))
    return rows + rows[:2] + [(1001, None), (None, None)]


def test_near_duplicates_match_all_pairs(workers):
    docs = near_copies()
    frame = workers.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, key string, node int")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame).collect()), key=repr)
    want = [(i, n, c, k if i is not None else True) for i, n, c, k in brute_components(docs)]
    assert got == sorted(want, key=repr)
    left = near_dedup.without_near_duplicates(frame)
    assert left.columns == frame.columns
    kept = {i for i, _, _, k in want if k and i is not None}
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 1


def test_near_duplicates_query(workers, sf_dir):
    docs = [(r.doc_id, r.text) for r in workers.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op5_near_dedup"](workers, sf_dir).collect()) == sorted(brute_components(docs))
    assert near_dedup.near_duplicates(workers.createDataFrame([], "doc_id long, text string")).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        values = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
        a, b = values[:400], values[-400:]
        true = len(np.intersect1d(a, b)) / len(values)
        both = near_dedup.superminhash([a, b])
        errors.append((both[0] == both[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.0435  # independent minima: 0.0433
    one = near_dedup.superminhash([np.array([5], np.uint64), np.empty(0, np.uint64)])
    assert len(set((one[0] >> np.uint64(56)).tolist())) == 128 and (one[1] == near_dedup._EMPTY).all()


def test_components(workers):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(3, 3)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(graph.components(workers.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for link in links if link[0] != link[1] for x in link}


def brute_repeats(docs, length=50):
    """{(doc_id, text): state of each word} with 1 kept, 2 removed; rows with equal id and text once."""
    places = collections.defaultdict(list)
    unique = sorted({d for d in docs if d[1] and d[0] is not None})
    for at, (i, t) in enumerate(unique):
        own = words(t)
        for j in range(len(own) - length + 1):
            places[tuple(own[j:j + length])].append((i, at, j))
    kept, removed = collections.defaultdict(set), collections.defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            found.sort()
            kept[found[0][1]].update(range(found[0][2], found[0][2] + length))
            for _, at, j in found[1:]:
                removed[at].update(range(j, j + length))
    return {(unique[at][0], x): x not in kept[at] for at in range(len(unique)) for x in kept[at] | removed[at]}


def spread(rows):
    return {(r.doc_id, x): r.removed for r in rows for x in range(r.start, r.end)}


def passages():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = [draw.choices(vocabulary, k=k) for k in (49, 50, 51, 70, 120)]
    docs = []
    for i in range(80):
        own = draw.choices(vocabulary, k=draw.randrange(0, 60))
        for part in draw.sample(shared, draw.randrange(0, 3)):
            own += part[draw.randrange(0, 6):] + draw.choices(vocabulary, k=draw.randrange(0, 30))
        docs.append((i, " ".join(own).upper() if i % 9 == 0 else " \n".join(own)))
    docs += [(100 + i, docs[i][1]) for i in range(10)] + [(200, "na " * 300), (201, "na " * 120), (202, " ".join(shared[4]))]
    alone = " ".join(draw.choices(vocabulary, k=90))
    return docs + docs[:2] + [(300, None), (301, ""), (302, alone), (302, alone)]


def test_repeats_match_all_windows(workers):
    docs = passages()
    frame = workers.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, key string, start int")
    rows = repeats.repeats(frame).collect()
    assert spread(rows) == brute_repeats(docs)
    left = {r.doc_id: r.text for r in repeats.without_repeats(frame).collect()}
    state = brute_repeats(docs)
    for i, t in docs:
        want = [w for x, w in enumerate((t or "").split()) if not state.get((i, x), False)]
        gone = not want and any(state.get((i, x)) for x in range(1))
        assert (i not in left) if gone else (left[i] or "").split() == want
    assert left[300] is None and left[301] == ""


def test_repeats_query(workers, sf_dir):
    docs = [(r.doc_id, r.text) for r in workers.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert spread(QUERIES["op4_repeats"](workers, sf_dir).collect()) == brute_repeats(docs)
    assert repeats.repeats(workers.createDataFrame([], "doc_id long, text string")).count() == 0
    nameless = workers.createDataFrame([(None, "x y " * 60), (1, "x y " * 60)], "doc_id long, text string")
    assert {(r.doc_id, r.removed) for r in repeats.repeats(nameless).collect()} >= {(None, True), (1, False)}


def brute_leaks(docs, items):
    """Items whose question and answer word triples stand in a passage that holds enough of their weight."""
    index = decontamination.build(items, decontamination.THRESHOLD)
    found = set()
    for i, text in docs:
        own = decontamination.terms(text)
        for start in range(0, max(1, len(own)), decontamination.STRIDE):
            inside = {index.number[w] for w in own[start:start + decontamination.PASSAGE] if w in index.number}
            scores = collections.Counter()
            for t in inside:
                for segment, impact in zip(*index.postings[t]):
                    scores[segment] += impact
            for segment, score in scores.items():
                item, question, answer = index.items[index.item_of[segment]]
                reach = len(question) + len(answer)
                near = own[max(0, start - reach):start + decontamination.PASSAGE + reach]
                if score >= decontamination.THRESHOLD - 1e-9 and min(
                        decontamination.overlap(question, near), decontamination.overlap(answer, near)) >= decontamination.OVERLAP:
                    found.add((i, item))
    return found


def test_decontamination_query(workers, sf_dir):
    docs = [(r.doc_id, r.text) for r in workers.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in workers.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](workers, sf_dir).collect()}
    assert got == brute_leaks(docs, items)
    whole = {(i, j) for i, t in docs for j, q in items if " ".join(q.split()) in " ".join(t.split())}
    assert whole and whole <= got


def test_decontamination_odd_rows(workers):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 200
    items = [(j, " ".join(draw.choices(vocabulary, k=draw.randrange(6, 150)))) for j in range(40)]
    items += [(40, "Question: what is " + " ".join(items[0][1].split()[:9]) + "?\nAnswer: " + " ".join(items[1][1].split()[:4])), (41, None), (42, ""), (43, "!")]
    docs = [(i, " ".join(draw.choices(vocabulary, k=60)) + " " + (items[i % 41][1] if i % 2 else "") + " x") for i in range(82)]
    docs += [(None, items[3][1]), (200, None), (201, ""), (202, "the " * 9000), docs[1]]
    frame = workers.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = workers.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    real = [x for x in items if x[1]]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == brute_leaks(docs, real)
    left = collections.Counter(r.doc_id for r in decontamination.clean(frame, bench).collect())
    bad = {i for i, _ in got}
    assert left == collections.Counter(i for i, _ in docs if i not in bad)
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame.limit(0), bench).count() == 0


def test_items_of_any_id_type(workers, monkeypatch):
    """Small, decimal and date ids, repeated items, an index in several parts, and columns named like private ones."""
    draw = random.Random(8)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(12)]
    frame = workers.createDataFrame([(i, f"before {t} after" if i % 2 else "clean " * 70, "x") for i, t in enumerate(texts)], "doc_id int, text string, _md5 string")
    bench = workers.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, texts[1])], "n int, text string")
    want = [(i, i) for i in range(1, 12, 2)] + [(1, 50)]
    for chars in (decontamination.INDEX_CHARS, 1500):
        monkeypatch.setattr(decontamination, "INDEX_CHARS", chars)
        for kind in ("smallint", "decimal(9,2)"):
            got = decontamination.contaminated(frame, bench.select(F.col("n").cast(kind).alias("item_id"), "text"))
            assert got.schema["item_id"].dataType.simpleString() == kind
            assert sorted((r.doc_id, int(r.item_id)) for r in got.collect()) == sorted(want)
    left = decontamination.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == list(range(0, 12, 2))


def test_private_names_and_ids_that_repeat(workers):
    """Other texts under one id and many null ids meet only their own spans; no column name clashes."""
    draw = random.Random(9)
    passage = " ".join(draw.choices([f"w{i}" for i in range(900)], k=55))
    docs = [(1, f"one {passage} uno"), (1, f"two {passage} due"), (1, "short"), (2, f"three {passage} tre")]
    docs += [(None, f"null{i} {passage}") for i in range(5)] + [(None, "alone " * 3), (None, None)]
    names = "_id long, _key string, _spans int, _bit int, _part int, _bits int, doc_id long, text string"
    frame = workers.createDataFrame([(7, "k", 1, 2, 3, 4, *d) for d in docs], names)
    left = repeats.without_repeats(frame)
    assert left.columns == frame.columns
    rows = left.collect()
    assert all(tuple(r)[:6] == (7, "k", 1, 2, 3, 4) for r in rows)
    got = collections.Counter((r.doc_id, " ".join(r.text.split()) if r.text else r.text) for r in rows)
    first = [t for i, t in docs[:2] if (1, t) in got]
    assert len(first) == 1 and got[2, "three tre"] == 1 and got[None, None] == 1 and got[None, "alone alone alone"] == 1 and got[1, "short"] == 1
    assert sum(passage in (t or "") for _, t in got.elements()) == 1 and len(rows) == len(docs)
    assert {t for i, t in got if i is None} >= {f"null{i}" for i in range(5)}
    lang = workers.createDataFrame([("a", 0.5, 1, "some words here", "en"), ("b", 0.1, 2, "12", "en")], "_lang string, _score double, _letters int, text string, lang string")
    found = language_id.in_known_language(lang.withColumn("doc_id", F.lit(1)), F.lit(True))
    assert [r._lang for r in found.collect()] == ["a"] and found.columns == [*lang.columns, "doc_id"]


@pytest.fixture(scope="module")
def predicted(workers):
    path = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in workers.read.parquet(f"{path}/documents.parquet").collect()}
    return lang, QUERIES["op10_language_id"](workers, path).collect()


def test_language_accuracy_on_held_out_rows(predicted):
    lang, rows = predicted
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(workers):
    docs = [(i, t, l) for i, (t, l) in enumerate([("the quick fox and the dog", "en"), ("der schnelle fuchs und der hund", "de")] * 30)]
    docs += [(None, None, "en"), (100, "", None), (101, "12 !?", "de"), (102, "the dog", None), (102, "the dog", None), (103, "und der " * 20000, None)]
    frame = workers.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(frame, language_id.learns_from(F.col("doc_id"))).collect()}
    assert {(None, "und"), (100, "und"), (101, "und"), (102, "en"), (103, "de")} <= got
    left = language_id.in_known_language(frame, F.lit(True))
    assert left.columns == frame.columns and left.count() == len(docs) - 3
    assert {r.lang_pred for r in language_id.identify(frame, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages_match_brute_force(workers, sf_dir):
    import corpus_pipeline

    docs = workers.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in workers.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    state = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        texts = {r.doc_id: r.text for r in state.collect()} if number < 5 else None
        out = stage(workers, state, sf_dir)
        if number == 4:
            assert {r.doc_id for r in out.collect()} == set(texts)
            break
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        if number == 0:
            assert {i: r.text for i, r in after.items()} == texts
        if number == 1:
            assert set(after) == {i for i, _, _, kept in brute_components(list(texts.items())) if kept}
        if number == 2:
            state_of = brute_repeats(list(texts.items()))
            for i, t in texts.items():
                want = [w for x, w in enumerate(t.split()) if not state_of.get((i, x), False)]
                assert after[i].text.split() == want if want else i not in after
                assert i not in after or after[i].n_chars == len(after[i].text)
        if number == 3:
            assert set(texts) - set(after) == {i for i, _ in brute_leaks(list(texts.items()), items)}
        assert all(after[i].source == rows[i].source for i in after)
        state = workers.createDataFrame(list(after.values()), docs.schema)
    assert corpus_pipeline.run(workers, sf_dir).count() > 0


def test_near_copies_are_decided_by_row(workers):
    """Two texts under one id, copies without id, repeated rows, columns named like the operator's own."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, other), (2, long + " x"), (None, long), (None, other), (None, "only this one here now"), (3, None), (3, None),
            (4, "twice the same row here"), (4, "twice the same row here"), (None, None)]
    frame = workers.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "doc_id long, text string, _id long, _code string")
    left = near_dedup.without_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted(r._id for r in left.collect()) == [0, 1, 5, 6, 7, 8, 10]


def test_a_worker_bounds_its_batches_and_gives_memory_back(workers, monkeypatch):
    """A batch of rows is no larger than what a worker handles at once, and freed memory goes back after the last."""
    import pyarrow as pa

    from partner_analytics.llm import common

    assert common.BATCH_BYTES <= common.CHUNK_CHARS
    assert int(common.ship(workers).conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.BATCH_BYTES
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400] * 20)], ["text"])
    parts = list(common.by_chunk(lambda part: part, most=1_000)([batch, batch]))
    assert sum(p.num_rows for p in parts) == 40 and max(p.num_rows for p in parts) <= 3 and given == [True]
