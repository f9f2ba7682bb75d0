"""Main text of web pages by nearest-URL page differencing.

1. A page is cut into text lines, one for each block, with character references decoded. Each line
   carries what the page says of it: elements that are page furniture by their tag, class or role
   (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) hold no main text, nor
   does what lies outside ``article`` and ``main`` on a page that has them. All other lines are candidates.
2. Pages of a host stand in the order of their URL paths, and each meets two on either side. The nearest
   is the one whose path shares the longest beginning. All lines of two pages are aligned by their
   longest common subsequence, and the candidates shared with the nearest page are deleted.
3. A page of which no candidate is its own, or that has all candidates of the other, is a copy (a print view, an
   addition) and tells nothing of templates. Where the nearest page is nearly the same, but with lines of
   its own on both sides, a line goes if a second page around shares it: a line on two pages may be the
   text of both, a line on three is the template's.
4. A declared article protects its lines: its candidates are aligned with those of the pages around, and
   a line is deleted where all of them, two at least, share it.

Equal pages of a host are one page here. The order over all hosts comes from a range partition, so a
host with a third of all pages is spread over many tasks; only hashes of lines travel to the
neighbour. Texts stay where they are: pages are cut once more at the end, and meet the numbers of
their deleted lines.
"""

from __future__ import annotations

import html as references
import os.path
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partner_analytics.llm.common import by_chunk, staged, width

#: fixed values: elements without main text, elements that end a block, elements that hold no content
FURNITURE = set("nav header footer aside form head title menu dialog button select option label fieldset".split())
RAW = set("script style noscript template textarea iframe svg math object canvas audio video".split())
BLOCKS = set("""address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: whole class, id and role names that mark furniture
REPLIES = set("respond reply replies".split())
MARKS = REPLIES | set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar
navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead notice notices cookie cookies consent gdpr alert
newsletter subscribe subscription share sharing social related recommended popup modal overlay login signup search pagination
pager widget toolbar contentinfo complementary site-header site-footer site-nav page-header page-footer main-nav main-menu
main-navigation nav-menu nav-bar side-bar cookie-banner cookie-notice cookie-consent social-share share-buttons related-posts
related-articles ad-banner ad-container""".split())
#: fixed values: parts of a class or id name that mark reader comments, and parts that say something of them only
COMMENT_PARTS = set("comment comments commentlist disqus".split())
ABOUT_PARTS = set("has no with without open closed count counter allow enabled disabled status".split())
#: share of two pages' characters from which a line needs a second witness
NEAR = 0.9
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$|["'])""", re.IGNORECASE)


def names_of(attributes: str) -> tuple[set[str], set[str], bool]:
    """(class and role names, id names, hidden) of an element."""
    names, ids, hidden = set(), set(), False
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true"
        if name in ("class", "role"):
            names.update(value.split())
        elif name == "id":
            ids.update(value.split())
    return names, ids, hidden


def is_comment(name: str) -> bool:
    """Whether a class, role or id name is that of reader comments."""
    parts = set(re.split("[-_]+", name))
    return name in REPLIES or not COMMENT_PARTS.isdisjoint(parts) and ABOUT_PARTS.isdisjoint(parts)


def lines_of(page: str | None) -> tuple[list[tuple[str, bool]], bool]:
    """(lines, declared): (line, candidate) of a page, and whether they come from a declared article."""
    if not page:
        return [], False
    found: list[tuple[str, str]] = []  # region, line
    held: list[str] = []
    stack: list[str] = []
    skip = region = talk = None  # depth of the stack at which furniture, the article or comments began
    where, seen_article, at, end = "", False, 0, len(page)

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            found.append(("furniture" if skip is not None else where, line))

    while at < end:
        mark = page.find("<", at)
        if mark != at:
            held.append(references.unescape(page[at:mark if mark >= 0 else end]))
            if mark < 0:
                break
        token = _TOKEN.match(page, mark) or _LOOSE.match(page, mark)
        if token is None:  # a bare "<" is text
            held.append("<")
            at = mark + 1
            continue
        at = token.end()
        closing, name, attributes = token.groups()
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        if closing:
            if name in stack:
                while stack.pop() != name:
                    pass
                if skip is not None and len(stack) < skip:
                    flush()
                    skip = None
                if talk is not None and len(stack) < talk:
                    talk = None
                if region is not None and len(stack) < region:
                    flush()
                    region, where = None, ""
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        stack.append(name)
        names, ids, hidden = names_of(attributes) if attributes and name not in ("html", "body") else (set(), set(), False)
        if name in HEADINGS:
            ids = set()  # a heading's id is an anchor
        talks = any(map(is_comment, names | ids))
        if talk is None and talks:
            talk = len(stack)
        if region is not None:
            ids = set()  # so are most of an article's
        if talk is None and (name == "main" or name == "article" and not seen_article):
            flush()
            skip, seen_article = None, seen_article or name == "article"  # furniture that was left open ends here
        elif skip is None and (name in FURNITURE or hidden or talks or not MARKS.isdisjoint(names | ids)):
            flush()
            skip = len(stack)
        if skip is None and region is None and name in ("article", "main"):
            region, where = len(stack), name
    flush()
    declared = any(where in ("article", "main") for where, _ in found)
    return [(line, where in ("article", "main") if declared else where == "") for where, line in found], declared


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL; empty where it has none."""
    try:
        parts = urlsplit((url or "").strip())
        return parts.netloc.lower(), parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return "", url or ""


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of ``a`` are in a longest common subsequence of both (divide and conquer, linear memory)."""
    inside, other = np.isin(a, b), np.isin(b, a)
    if not (inside.all() and other.all()):  # lines of one side only change nothing
        keep = np.zeros(len(a), bool)
        if inside.any():
            keep[inside] = common_lines(a[inside], b[other])
        return keep
    keep = np.zeros(len(a), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            keep[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            keep[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            keep[a0] = bool((b[b0:b1] == a[a0]).any())
            continue
        middle = (a0 + a1) // 2
        forward, backward = _lengths(a[a0:middle], b[b0:b1]), _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(forward + backward))
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return keep


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for item in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == item)))
    return row


def parsed(html: str | None, url: str | None) -> tuple[str, str, bytes, list[tuple[str, bool]], bool]:
    """(host, path, key, lines, declared) of a page; ``key`` is a 128-bit hash of the host and the lines."""
    host, path = place_of(url)
    lines, declared = lines_of(html)
    own = xxhash.xxh3_128(host.encode() + (b"\0\1" if declared else b"\0\0"))
    for line, candidate in lines:
        own.update(b"\0\1" if candidate else b"\0\0")
        own.update(line.encode())
    return host, path, own.digest(), lines, declared


def line_hashes(pages: DataFrame) -> DataFrame:
    """(host, path, key, declared, hashes, sizes) of each page; a line's size is its characters if it is a candidate, else 0."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [parsed(*x) for x in zip(part.column("html").to_pylist(), part.column("url").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.binary()), pa.array([x[4] for x in found], pa.bool_()),
             pa.array([[_signed(line) for line, _ in x[3]] for x in found], pa.list_(pa.int64())),
             pa.array([[len(line) if candidate else 0 for line, candidate in x[3]] for x in found], pa.list_(pa.int32()))],
            ["host", "path", "key", "declared", "hashes", "sizes"])

    return pages.mapInArrow(by_chunk(run, "html"), "host string, path string, key binary, declared boolean, hashes array<long>, sizes array<int>")


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, lines) of each page, with its candidates alone."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [parsed(*x) for x in zip(part.column("html").to_pylist(), part.column("url").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array([x[2] for x in found], pa.binary()),
             pa.array([[line for line, candidate in x[3] if candidate] for x in found], pa.list_(pa.string()))],
            ["page_id", "url", "key", "lines"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(by_chunk(run, "html"), f"page_id {kind}, url string, key binary, lines array<string>")


def neighbours(pages: DataFrame) -> DataFrame:
    """(row, other): the two pages before and the two after in the order of host and path, same host only."""
    order = ["host", "path", "key", "row"]
    light = staged(pages.select(*order).repartitionByRange(width(pages.sparkSession), *order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("at"), "host", "row"), "order")  # partition << 33 | place in it
    slices = light.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.max("at").alias("last"), F.min("at").alias("first"))
    # as many rows as partitions
    border = slices.select("last", F.lead("first").over(Window.orderBy("slice")).alias("next_first"))
    left = light.join(F.broadcast(border), light["at"] == border["last"], "left").select(
        "row", "host", F.coalesce("next_first", F.when(F.col("last").isNull(), F.col("at") + 1)).alias("next"))
    right = light.select(F.col("at").alias("next"), F.col("host").alias("next_host"), F.col("row").alias("other"))
    pairs = staged(left.join(right, "next").filter("host = next_host").select("row", "other"), "neighbours")
    second = pairs.join(pairs.select(F.col("row").alias("other"), F.col("other").alias("far")), "other").select("row", F.col("far").alias("other"))
    after = pairs.unionByName(second)
    return after.unionByName(after.select(F.col("other").alias("row"), F.col("row").alias("other")))


def deleted_lines(path: str, declared: bool, hashes: list[int], sizes: list[int], others: list[dict]) -> list[int]:
    """Numbers among a page's candidates of those that are deleted, given the pages around it."""
    own, weight = np.array(hashes, np.int64), np.array(sizes, np.int64)
    inside, size = own[weight > 0], weight[weight > 0]
    shared, near = [], []
    for other in sorted(others, key=lambda o: (-len(os.path.commonprefix([o["path"], path])), o["row"])):
        lines, others_size = np.array(other["hashes"], np.int64), np.array(other["sizes"], np.int64)
        same = common_lines(inside, lines[others_size > 0])
        if same.all() or same.sum() == (others_size > 0).sum():
            continue  # a copy
        shared.append(same if declared else common_lines(own, lines)[weight > 0])
        near.append(2 * size[same].sum() >= NEAR * (size.sum() + others_size.sum()))
    if not shared:
        return []
    witnesses = max(2, len(shared)) if declared else 2 if near[0] else 1
    return np.flatnonzero(shared[0] & (np.sum(shared, axis=0) >= witnesses)).tolist()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars), one row for each row of ``pages``.

    A null, empty or broken page gives the text its lines give, the empty text if there are none. Null
    URLs make up a host of their own. A page without a page of other lines on its host keeps all
    candidates. Repeated rows and pages of a host with equal lines get one result. Long pages are read
    to their end.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    distinct = staged(line_hashes(source.select("url", "html")).groupBy("key").agg(
        F.min("host").alias("host"), F.min("path").alias("path"), F.first("declared").alias("declared"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"),
    ).select(F.monotonically_increasing_id().alias("row"), "*"), "lines")
    pairs = neighbours(distinct.select("row", "host", "path", "key"))
    others = distinct.select(F.col("row").alias("other"), F.struct("row", "path", "declared", "hashes", "sizes").alias("x")).join(pairs, "other").groupBy("row").agg(
        F.collect_list("x").alias("others"))  # four at most
    asked = distinct.join(others, "row").select("key", "path", "declared", "hashes", "sizes", "others")

    def compare(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [part.column(c).to_pylist() for c in ("key", "path", "declared", "hashes", "sizes", "others")]
        found = [(key, cut) for key, *page in zip(*columns) if (cut := deleted_lines(*page))]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.binary()), pa.array([c for _, c in found], pa.list_(pa.int32()))], ["key", "cut"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 200):
                yield compare(part.slice(at, 200))

    cuts = staged(asked.mapInArrow(batches, "key binary, cut array<int>"), "cuts")
    left = F.filter("lines", lambda _, i: ~F.array_contains("cut", i))
    return candidates(source).join(cuts, "key", "left").select(
        "page_id", "url", F.array_join(F.when(F.col("cut").isNull(), F.col("lines")).otherwise(left), " ").alias("text"),
    ).withColumn("n_chars", F.length("text").cast("long"))


def _signed(line: str) -> int:
    """Spark's xxhash64 of a string."""
    value = xxhash.xxh64_intdigest(line.encode(), 42)
    return value - (1 << 64) if value >= 1 << 63 else value
