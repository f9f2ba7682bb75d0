"""The prefix trie against dictionaries of whole prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle_check import connect, normal

from partner_analytics.llm import prefix_trie
from partner_analytics.llm.queries import ORACLES, QUERIES

ROWS = "conv_id long, turn int, role string, text string, slice string, place int"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            halves = tuple(int.from_bytes(digest[i:i + 8], "big", signed=True) for i in (0, 8))
            own[conv].append(((turn is not None, turn or 0, *halves), (role, text)))
    own = {c: [x for _, x in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 6, (abs(c) // 100 * 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    return sorted((convs[0], len(p), members[p[:-1]][0] if p else -1, len(convs), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, convs in members.items())


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def odd_conversations():
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 130), *range(-120, -90), 1000, 1001, 1007, 250, 251, 10**15]:
        if c in (1000,):
            continue
        for t in range(draw.choice([1, 2, 3, 7, 12])):
            rows.append((c, t, draw.choice(["user", "assistant", None, ""]), draw.choice(["hi", "yes", None, "", "é" * 5, "no"]), "x", 1))
    rows += [(3, 1, "user", "hi", "x", 1)] * 3 + [(3, None, "user", "first", "x", 1), (None, 1, "user", "hi", "x", 1), (4, 2, "us", "erhi", "x", 1)]
    rows += [(7, t, "user", f"long {t}", "x", 1) for t in range(300)] + [(9, 0, "user", "z" * 300_000, "x", 1)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [prefix_trie.SLICE, 37])
def test_trie_against_brute_force(workers, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "SLICE", size)  # 37 rows a slice cut the long conversation many times
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    rows = odd_conversations()
    assert found(prefix_trie.prefix_trie(workers.createDataFrame(rows, ROWS))) == brute(rows)


def test_trie_of_empty_tables(workers):
    assert prefix_trie.prefix_trie(workers.createDataFrame([], ROWS)).collect() == []
    nameless = workers.createDataFrame([(None, 1, "user", "hi", "x", 1)], ROWS)
    assert prefix_trie.prefix_trie(nameless).collect() == []


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 50, 4000).astype(np.uint64), draw.integers(0, 50, 4000).astype(np.uint64)
    table = prefix_trie.SlotTable(a, b)
    slots = table.find(a, b)
    assert table.size == len(set(zip(a, b))) == len(np.unique(slots)) and slots.min() == 0 and slots.max() == table.size - 1
    assert (table.find(a + np.uint64(100), b) == -1).all()


def test_shared_digests_start_again(workers, monkeypatch):
    plain, prefixes, seeds = prefix_trie._turn_hash, prefix_trie.prefixes, []

    def weak(place, c1, c2, seed):  # the first seed tells few turns apart
        return tuple(x & np.uint64(3 if seed == 0 else 2**64 - 1) for x in plain(place, c1, c2, seed))

    monkeypatch.setattr(prefix_trie, "_turn_hash", weak)
    monkeypatch.setattr(prefix_trie, "prefixes", lambda places, seed: (seeds.append(seed), prefixes(places, seed))[1])
    rows = [(c, t, "user", f"{c} {t}", "x", 1) for c in range(1, 60) for t in range(3)]
    assert found(prefix_trie.prefix_trie(workers.createDataFrame(rows, ROWS))) == brute(rows)
    assert seeds == [0, 1]


def test_trie_query_matches_definition(workers, sf_dir):
    df = QUERIES["op13_prefix_trie"](workers, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES["op13_prefix_trie"])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([d[0] for d in cursor.description], cursor.fetchall())
