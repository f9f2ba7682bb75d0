"""The filter audit against a document-by-document replay of all orders."""

import collections
import itertools
import re

from oracle_check import connect, normal

from partner_analytics.llm import filter_audit
from partner_analytics.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string, cells string"
LABELS = "doc_id long, quality int, toxic int, text string"


def failures(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    capitals = len(re.findall("[A-Z]", text))
    return {f for f, bad in zip("ABCD", [len(own) < 200, 100 * len(set(own)) < 50 * len(own), 100 * capitals > 2 * len(text),
                                         bool(re.search(r"[#$%&*|]", text))]) if bad}


def replay(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, text, source, *_ in docs:
        bad = failures(text or "")
        if i is not None and i > least[text or ""]:
            bad.add("E")
        parts[source or ""].append((bad, i in good, i in toxic))
    rows, credit = [], collections.Counter()
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(members)
            for step, f in enumerate(order, 1):
                falls = [m for m in alive if f in m[0]]
                alive = [m for m in alive if f not in m[0]]
                failing = sum(f in m[0] for m in members)
                credit[part, f] += len(falls)
                rows.append([part, order, step, len(alive), len(falls), failing - len(falls), sum(m[0] == {f} for m in members),
                             sum(m[1] for m in falls), sum(m[2] for m in falls)])
    return sorted((*r, credit[r[0], r[1][r[2] - 1]]) for r in rows)


def long_text(n, distinct, extra=""):
    return " ".join(f"w{i % distinct}" for i in range(n)) + extra


def test_audit_against_replay(workers):
    texts = [None, "", "  \t", long_text(250, 250), long_text(250, 250), long_text(400, 20), long_text(199, 199),
             long_text(200, 100), long_text(300, 300, " 100%"), "SHOUTED " * 300, long_text(250, 240, " É | é"), long_text(20_000, 15_000),
             "a b " * 150, "#", long_text(250, 250, "\x0bx\x1fy")]
    docs = [(i, texts[i % len(texts)], ["s", None, "", "hot", "hot"][i % 5], "x") for i in range(60)]
    docs += [(None, texts[3], "s", "x"), (None, None, None, "x"), (3, texts[3], "s", "x"), (3, texts[3], "other", "x")]
    labels = [(i, i % 2, i % 3 % 2, "t") for i in range(0, 60, 2)] + [(2, 1, 1, "t"), (None, 1, 1, "t"), (3, None, None, "t"), (3, 1, None, "t")]
    found = filter_audit.audit(workers.createDataFrame(docs, DOCS), workers.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == replay(docs, labels)


def test_audit_of_empty_tables(workers):
    none, docs = workers.createDataFrame([], DOCS), workers.createDataFrame([(1, "a", "s", "x")], DOCS)
    labels = workers.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels).count() == 600


def test_audit_query_matches_definition(workers, sf_dir):
    found = QUERIES["op11_filter_audit"](workers, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES["op11_filter_audit"])
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(found.columns, [tuple(r) for r in found.collect()]) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan
