"""HTML text, token counts and packing against plain versions."""

import html
import math
import re
import zlib

import numpy as np
import pytest

from partner_analytics.llm import html_text, packing, token_counts
from partner_analytics.llm.pieces import Pieces, pieces, vocabulary
from partner_analytics.llm.queries import QUERIES

ODD = ["", None, "I'S it'LL don'T", "a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ Σας ① x²½", "日本語 abc_def--'re'd", "a\x1cb!\x1c!c",
       "é é", "😀😀 ok!!'s", "x " * 5000, "x " * 5000]


@pytest.fixture(scope="module")
def odd_docs(workers):
    rows = [(i if i else None, t, "clash", i) for i, t in enumerate(ODD)] + [(3, ODD[3], "clash", 3)]
    return workers.createDataFrame(rows, "doc_id long, text string, token string, n long")


def library_counts(texts):
    tool = pieces(vocabulary()).library
    return [len(tool.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_match_library():
    tool = pieces(vocabulary())
    rng = np.random.default_rng(5)
    pools = [list(range(0x20, 0x250)), list(range(0x250, 0x3000)), [ord(c) for c in " \t\n'sSdDlLrRemMvVtT_<|>\x1c\x85\xa0"]]
    for _ in range(3000):
        text = "".join(chr(rng.choice(pools[rng.integers(3)])) for _ in range(rng.integers(1, 14)))
        want = tool.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.ids_of(text), "<u4").tolist() == want, ascii(text)
        assert sum(map(len, tool.encode(tool.split(text)))) == len(want), ascii(text)


def test_words_of_letters_are_merged_at_once_and_kept_once():
    tool = Pieces(vocabulary())
    text = " ".join(["qzxwv", "Straße", "ªº", "it's", "a1b", "été", "''s"] * 3)
    assert np.frombuffer(tool.ids_of(text), "<u4").tolist() == tool.library.encode(text, add_special_tokens=False).ids
    assert "qzxwv" in tool.word_ids and "qzxwv" not in tool.ids and "it" in tool.ids
    assert tool.merged([]) == [] and tool.merged(["<|endoftext|>"]) == [np.asarray([tool.special["<|endoftext|>"]], "<u4").tobytes()]


@pytest.mark.parametrize("hot", [1e-6, 2.0])
def test_token_counts(odd_docs, hot):
    got = sorted(token_counts.token_counts(odd_docs, hot=hot, limit=100).collect(), key=repr)
    texts = [*ODD, ODD[3]]
    ids = [None, *range(1, len(ODD)), 3]
    want = [(i, len((t or "").encode()), n, n > 100) for i, t, n in zip(ids, texts, library_counts(texts))]
    assert [tuple(r) for r in got] == sorted(want, key=repr)


def test_token_counts_query(workers, sf_dir):
    docs = {r.doc_id: r.text for r in workers.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](workers, sf_dir).collect()}
    assert got == dict(zip(docs, library_counts(docs.values())))


def check_packing(rows, docs, capacity):
    """Every document's ids lie whole in sequences that are gapless and not too long."""
    tool = pieces(vocabulary())
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, texts in docs.items():
        want = []
        for text in texts:
            ids = tool.ids_of(text) + np.array([1], "<u4").tobytes()
            want += [(p, at // 4, len(ids[at:at + 4 * capacity]) // 4, zlib.crc32(ids[at:at + 4 * capacity]))
                     for p, at in enumerate(range(0, len(ids), 4 * capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc.pop(doc)) == sorted(want)
    assert not by_doc
    return len(by_sequence)


def test_packing_odd_rows(odd_docs):
    docs = {}
    for i, t in [*zip([None, *range(1, len(ODD))], ODD), (3, ODD[3])]:
        docs.setdefault(i, []).append(t)
    rows = packing.pack(odd_docs, capacity=64, shard=8).collect()
    assert check_packing(rows, docs, 64) <= math.ceil(sum(r.length for r in rows) / 64) + 1


def test_packing_query_reaches_the_bound(workers, sf_dir):
    docs = {r.doc_id: [r.text] for r in workers.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_packing"](workers, sf_dir).collect()
    assert check_packing(rows, docs, 4096) <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_crossover_keeps_every_piece_once():
    import random

    size = [random.Random(i).randrange(1, 4096) for i in range(300)]
    a, b = [], []
    packing.best_fit(a, [], list(range(300)), size, 4096)
    packing.best_fit(b, [], list(range(299, -1, -1)), size, 4096)
    child = packing.cross(a, b, size, 4096, random.Random(1))
    assert sorted(i for own in child for i in own) == list(range(300))
    assert max(packing.fill(child, size)) <= 4096
    best = packing.evolve(size, [a, b], 3)
    assert packing.fitness(best, size, 4096) >= max(packing.fitness(a, size, 4096), packing.fitness(b, size, 4096))


def test_genetic_search_comes_near_a_known_optimum():
    import random

    draw, size = random.Random(1), []
    for _ in range(600):
        a = draw.randint(4096 // 3 + 1, 4096 // 2 - 50)
        b = draw.randint(4096 // 4 + 1, (4096 - a) // 2)
        size += [a, b, 4096 - a - b]
    plain = []
    packing.best_fit(plain, [], sorted(range(1800), key=lambda i: -size[i]), size, 4096)
    best = packing.evolve(size, [], 5)
    assert len(plain) > 660 and len(best) <= 606
    assert sorted(i for own in best for i in own) == list(range(1800)) and max(packing.fill(best, size)) <= 4096


def test_lower_bound_holds_for_all_packings():
    import itertools
    import random

    draw = random.Random(7)
    for _ in range(60):
        size = [draw.randint(1, 10) for _ in range(draw.randint(1, 6))]
        fewest = min(len({*places}) for places in itertools.product(range(len(size)), repeat=len(size))
                     if all(sum(s for s, p in zip(size, places) if p == b) <= 10 for b in range(len(size))))
        assert -(-sum(size) // 10) <= packing.lower_bound(size, 10) <= fewest
    assert packing.lower_bound([], 10) == 0 and packing.lower_bound([6] * 5, 10) == 5


def test_empty_tables(workers):
    docs = workers.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert packing.pack(docs).count() == 0
    assert token_counts.token_counts(docs).count() == 0
    assert html_text.main_text(workers.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_article_text_query(workers, sf_dir):
    got = {r.page_id: r for r in QUERIES["op1_html_text"](workers, sf_dir).collect()}
    pages = workers.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page.html, re.DOTALL).group(1)
        blocks = [re.sub(r"<[^>]*>?", "", b) for b in re.split(r"<(?:/?p|br|/?h1)>", inner)]
        want = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert (got[page.page_id].text, got[page.page_id].n_chars) == (want, len(want))


PAGES = [
    (1, "http://h.x/a/1", "<div>Home | News</div><p>One &amp; two</p><div>All rights</div>"),
    (2, "http://h.x/a/2", "<div>Home | News</div><p>Three<b>!</b>&nbsp;x</p><p>Four</p><div>All rights</div>"),
    (3, "http://h.x/b", "<div class='x menu'>M</div><header>H</header><article>In<aside>S</aside><!-- c --><br>side"
        "<section class='comments'><article>C</article></section></article><div>Out</div>"),
    (4, None, None), (None, "http://solo.y/", "plain <p>text < 3 &am"), (5, "http://[", "<script>x</p>"), (6, "", ""),
    (7, "http://t.z/1", "<div class=ad>A<article>B</article>"), (7, "http://t.z/1", "<div class=ad>A<article>B</article>"),
    (8, "http://long.z/", "<p>w</p>" * 20000),
]


def test_pages_without_article_are_compared(workers):
    frame = workers.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, text string, host string")
    got = sorted(((r.page_id, r.text) for r in html_text.main_text(frame).collect()), key=repr)
    want = [(1, "One & two"), (2, "Three! x Four"), (3, "In side"), (4, ""), (None, "plain text < 3 &am"), (5, ""), (6, ""),
            (7, "B"), (7, "B"), (8, " ".join(["w"] * 20000))]
    assert got == sorted(want, key=repr)


def texts_of(workers, pages):
    frame = workers.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(frame).collect()}


def test_shared_lines_of_articles_are_deleted(workers):
    page = "<nav>Menu</nav><article><p>{} long own text of this page</p><p>Read more from us</p></article><p>Outside</p>"
    got = texts_of(workers, [(i, f"http://n.x/a/{i}", page.format(w)) for i, w in enumerate(["First", "Second", "Third"])]
                   + [(9, "http://n.x/a/1b", "<p>Menu</p><p>Bare page</p><p>Read more from us</p>")])
    assert got == {0: "First long own text of this page", 1: "Second long own text of this page",
                   2: "Third long own text of this page", 9: "Bare page"}


@pytest.mark.parametrize("page, want", [
    ("<main><p>Text</p></main><section class=comments><article>C</article></section>", "Text"),
    ("<main><p>Text</p><div id=comments><article>C</article></div><p>More</p></main>", "Text More"),
    ("<div class=sidebar><div class=comment><article>C</article></div></div><p>Text</p>", "Text"),
    ("<section class=comments><main>C</main></section><p>Text</p>", "Text"),
    ("<section class=comments><article>C</article></section><article>Text</article>", "Text"),
    ("<div class='content has-sidebar'><main>Text</main></div>", "Text"),
    ("<div class='content has-sidebar'><p>Text</p></div><div class=sidebar>S</div>", "Text"),
    ("<div class='header'>H<main>Text</main></div>", "Text"),
    ("<div class='fixed-header'><p>Text</p></div>", "Text"),
    ("<article><h2 id='search'>Search</h2><section id='related-work'>A</section><section id='social'>B</section></article>", "Search A B"),
    ("<main>Text</main><article>More</article>", "Text More"),
    ("<article class=comment>C</article><p>Text</p>", "Text"),
    ("<article>Text<div class='comment-1'>C</div><ul class='reader-comments-list'><li>C</ul><p id='user_comment'>C</p></article>", "Text"),
    ("<div class='has-comments'><p>Text</p><p class='commentary'>More</p></div>", "Text More"),
])
def test_main_text_is_not_lost_to_names_or_comments(page, want):
    assert " ".join(line for line, candidate in html_text.lines_of(page)[0] if candidate) == want


def test_template_larger_than_the_text_is_deleted(workers):
    lines = "".join(f"<p>Line {i} of the template of this host</p>" for i in range(30))
    pages = [(i, f"http://t.x/{i}", f"{lines}<p>Own {i}</p>{lines}") for i in range(3)]
    promo = "<p>Subscribe now to read everything that we write, wherever you are</p>"
    pages += [(i, f"http://p.x/{i}", f"<article><p>Own {i}</p>{promo}</article>") for i in range(10, 15)]
    # two pages that differ in a line may be one text twice; nothing tells a template there
    pages += [(i, f"http://two.x/{i}", f"<p>Dated {i}</p>{lines}") for i in (20, 21)]
    got = texts_of(workers, pages)
    assert {i: got[i] for i in (*range(3), *range(10, 15))} == {i: f"Own {i}" for i in (*range(3), *range(10, 15))}
    assert all(got[i].startswith(f"Dated {i} Line 0") and len(got[i]) > 1000 for i in (20, 21))


def test_copies_keep_their_text(workers):
    page = "<p>Home | News</p>{}<p>All rights</p>"
    long = "".join(f"<p>Sentence {i} of a long page</p>" for i in range(40))
    pages = [(1, "http://c.x/a", page.format(long)), (2, "http://c.x/a", page.format(long)), (3, "http://c.x/a?print=1", page.format(long)),
             (4, "http://c.x/a?v=2", page.format(long + "<p>Corrected</p>")), (5, "http://c.x/b", page.format("<p>Else, and long enough</p>")),
             (6, "http://d.x/a", page.format(long)), (7, "http://d.x/b", page.format(long + "<p>Corrected</p>"))]
    got, own = texts_of(workers, pages), " ".join(f"Sentence {i} of a long page" for i in range(40))
    assert got[4] == f"{own} Corrected" and got[5] == "Else, and long enough"
    assert all(own in got[i] for i in (1, 2, 3)) and got[1] == got[2] == got[3]
    assert own in got[6] and own in got[7]


def test_common_lines_is_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        kept, at = a[html_text.common_lines(a, b)], 0
        assert len(kept) == table[-1, -1]
        for item in b:
            at += at < len(kept) and kept[at] == item
        assert at == len(kept)
