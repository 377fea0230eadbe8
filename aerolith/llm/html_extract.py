"""Main text of web pages: differences to the page with the nearest URL, checked by the page's structure.

Parts that markup names as menus, notices, adverts, forms, comments and the like are left out.  Every page is
then paired with its nearest page: pages of a host are sorted by URL path, those with a main element apart from the others, each
goes with the neighbour whose path agrees longest, and text lines are aligned by longest common subsequence (lines by their 64-bit hashes, so that
no text moves).  Lines that are not shared are the page's own.  A page without ``article`` or ``main`` element (or
``role=main``) keeps its own lines; one with both has its text in the article, unless that holds under a tenth of
the element's text, of own lines as of all (a teaser beside the story).

Inside the chosen element the differences decide too, checked by structure.  A shared line stays where it is a
paragraph, heading, list item, cell or the element's own text: two articles of a host may share a paragraph or all of
it.  A shared line of nothing but links, or straight in a box (``div``, ``section``), is the template's and goes.  Lines in
boxes that hold more text than the page's own lines stay, as the pages are then versions of one article, and a page
without a line of its own that is more than links keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.util import BROADCAST_BYTES
from aerolith.llm.common import materialize

# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset("script style noscript template head title nav footer aside form button select textarea svg math iframe object dialog menu audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose end tag is often left out: they end where the next block of their kind begins.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
# Elements that only lay out a page, so that text straight in them need not be the article's.
BOXES = frozenset("address center details div fieldset figure legend section summary".split())
# Words of class, id and role attributes that name what is not main text.
OTHER_PARTS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer hidden "
                        "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related share sharing "
                        "sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search disqus".split())


def _names(attrs: dict[str, str | None]) -> set[str]:
    text = " ".join(attrs.get(k) or "" for k in ("class", "id", "role"))
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


class _Page(HTMLParser):
    """Blocks of visible text, with whether each is inside the page's main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, str]] = []  # open elements: name, whether it is no main text, main kind
        self.skipped = 0
        self.inside = {"article": 0, "main": 0}
        self.part: list[str] = []
        self.block = ""  # the block element that text is in
        self.links = 0
        self.only_links = True  # of the part
        self.blocks: list[tuple[str, int]] = []
        self.seen = {"article": False, "main": False}

    def flush(self):
        if self.part:
            text = " ".join("".join(self.part).split())
            if text:
                self.blocks.append((text, ARTICLE * (self.inside["article"] > 0) + MAIN * (self.inside["main"] > 0)
                                    + (LINKS if self.only_links else BOXED * (self.block in BOXES))))
            self.part, self.only_links = [], True

    def _pop(self):
        tag, skip, kind = self.stack.pop()
        self.links -= tag == "a"
        self.skipped -= skip
        if kind:
            self.inside[kind] -= 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag not in VOID:
                self.block = tag
        if tag == "br":
            self.part.append(" ")
        if tag in VOID:
            return
        while self.stack and self.stack[-1][0] in OPEN_ENDED and tag in BLOCKS and (self.stack[-1][0] in ("p", tag)):
            self._pop()
        attrs = dict(attrs)
        kind = "article" if tag == "article" else "main" if tag == "main" or (attrs.get("role") or "").lower() == "main" else ""
        # a page's header is no main text, an article's own header holds its title
        skip = (tag in NEVER_TEXT or (tag == "header" and not self.inside["article"])
                or (tag not in ("html", "body") and bool(_names(attrs) & OTHER_PARTS))
                or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true")
        if tag in OPEN_ENDED and not skip and not kind:
            return
        self.stack.append((tag, skip, kind))
        self.links += tag == "a"
        self.skipped += skip
        if kind:
            self.inside[kind] += 1
            self.seen[kind] = self.seen[kind] or not self.skipped

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                while len(self.stack) > at:
                    self._pop()
                break
        if tag in BLOCKS:
            self.block = next((t for t, _, _ in reversed(self.stack) if t in BLOCKS), "")

    def handle_data(self, data):
        if not self.skipped:
            self.part.append(data)
            self.only_links = self.only_links and (self.links > 0 or not data.strip())


#: Structure of a page (``found``) and of a block (``kind``, bits): nothing, a main element, an article.
NONE, MAIN, ARTICLE = 0, 1, 2
#: More bits of a block: all of its text is in links, or straight in one of BOXES.
LINKS, BOXED = 4, 8


def page_parts(html: str | None) -> tuple[list[str], list[int], int]:
    """All text blocks outside named other parts, the elements that each is in, and the page's structure."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    found = ARTICLE if page.seen["article"] else MAIN if page.seen["main"] else NONE
    return [t for t, _ in page.blocks], [kind for _, kind in page.blocks], found


def page_blocks(html: str | None) -> tuple[list[str], bool]:
    """The page's text blocks by its structure alone and whether they come from a main element."""
    blocks, kinds, found = page_parts(html)
    return [t for t, kind in zip(blocks, kinds) if not found or kind & found], found != NONE


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence of both, in space of one row."""
    number = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
    in_both = set(a) & set(b)  # no other line is in any common subsequence
    at = [i for i, t in enumerate(a) if t in in_both]
    x, y = np.array([number[a[i]] for i in at], np.int64), np.array([number[t] for t in b if t in in_both], np.int64)
    shared = np.zeros(len(x), bool)

    def lengths(p, q):
        row = np.zeros(len(q) + 1, np.int64)
        for v in p:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (q == v)))
        return row

    work = [(0, len(x), 0, len(y))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and x[i] == y[k]:
            shared[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            shared[j - 1] = True
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            shared[i] = bool((y[k:m] == x[i]).any())
            continue
        mid = (i + j) // 2
        cut = k + int((lengths(x[i:mid], y[k:m]) + lengths(x[mid:j][::-1], y[k:m][::-1])[::-1]).argmax())
        work += [(i, mid, k, cut), (mid, j, cut, m)]
    out = [False] * len(a)
    for i, v in zip(at, shared.tolist()):
        out[i] = v
    return out


def kept_blocks(lengths: list[int], kinds: list[int], found: int, shared: list[bool]) -> list[int]:
    """Numbers of the blocks that are main text, given which lines the nearest page shares."""
    every = range(len(lengths))
    own = [i for i in every if not shared[i]] or list(every)
    if not found:
        return own

    def held(k, rows):
        return sum(lengths[i] for i in rows if kinds[i] & k)
    if found == ARTICLE and all(10 * held(ARTICLE, rows) < held(MAIN, rows) for rows in (own, every)):
        found = MAIN
    inside = [i for i in every if kinds[i] & found]
    theirs = sum(lengths[i] for i in inside if not shared[i] and not kinds[i] & LINKS)
    if not theirs:
        return inside
    templates = LINKS | (BOXED if held(BOXED, [i for i in inside if shared[i]]) <= theirs else 0)
    return [i for i in inside if not (shared[i] and kinds[i] & templates)]


PARSED = "row long, page_id long, url string, host string, path string, found int, kinds array<int>, blocks array<string>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [page_parts(h) for h in rows["html"]]
        yield pd.DataFrame({"row": rows["row"], "page_id": rows["page_id"], "url": rows["url"], "host": rows["host"], "path": rows["path"],
                            "found": [f for _, _, f in found], "kinds": [k for _, k, _ in found], "blocks": [b for b, _, _ in found]})


def _agreement(a: str, b: str) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for r in rows.itertuples():
            before = r.before if r.before is not None and r.host_before == r.host else None
            after = r.after if r.after is not None and r.host_after == r.host else None
            if before is not None and after is not None:
                nearest = after if _agreement(r.path, r.path_after) > _agreement(r.path, r.path_before) else before
            else:
                nearest = before if before is not None else after
            lines, kinds = list(r.lines), list(r.kinds)
            shared = common_lines(lines, list(nearest)) if nearest is not None else [False] * len(lines)
            kept = kept_blocks(list(r.lengths), kinds, r.found, shared)
            plain = [i for i in range(len(lines)) if not r.found or kinds[i] & r.found]
            out.append(None if kept == plain else kept)
        yield pd.DataFrame({"row": rows["row"], "kept": out})


def _ranked(df: DataFrame) -> DataFrame:
    """Number rows 0, 1, ... in the order of host, path and row: sorted in parts, each part's numbers
    shifted by the rows before it (one number a part)."""
    parts = materialize(df.orderBy("host", "path", "row").select("row", F.monotonically_increasing_id().alias("at")), "order")
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    shift = df.sparkSession.createDataFrame(offsets, "part long, start long")
    return df.join(parts.select("row", part.alias("part"), inner.alias("inner")).join(F.broadcast(shift), "part")
                   .select("row", (F.col("start") + F.col("inner")).alias("rank")), "row")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Blocks are in page order, joined by an empty line; white space inside a block is one space and
    character references are decoded.  Null and empty html, and pages without text, give an empty
    text.  Null urls are a host of their own (so are urls without one).  Repeated rows are each
    returned: copies of a page without a main element share all lines and so keep them.  An empty
    table gives no rows; only the named columns are read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    own = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                       F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), F.col(html_col).alias("html"))
    parsed = materialize(own.mapInPandas(_parse, PARSED), "blocks")
    # hashes and lengths of the lines are compared, texts stay where they are; pages with and without a main element are
    # made of different templates, so that each goes with its like
    lines = parsed.select("row", F.concat(F.when(F.col("found") == NONE, "0 ").otherwise("1 "), "host").alias("host"), "path", "found", "kinds", F.transform("blocks", lambda t: F.xxhash64(t)).alias("lines"),
                          F.transform("blocks", lambda t: F.char_length(t)).alias("lengths"))
    ranked = materialize(_ranked(lines), "ranked")

    def side(d, name):
        return ranked.select((F.col("rank") + d).alias("rank"), F.col("lines").alias(name), F.col("host").alias(f"host_{name}"), F.col("path").alias(f"path_{name}"))
    pairs = ranked.join(side(1, "before"), "rank", "left").join(side(-1, "after"), "rank", "left")
    # rows that the differences change; the others keep what their structure says
    changed = materialize(pairs.drop("rank").mapInPandas(_differ, "row long, kept array<int>").where("kept IS NOT NULL"), "kept")
    numbers = changed.agg(F.coalesce(F.sum(F.size("kept") + 8), F.lit(0))).first()[0]
    both = parsed.join(F.broadcast(changed) if 4 * numbers <= BROADCAST_BYTES else changed, "row", "left")
    plain = F.filter("blocks", lambda t, i: (F.col("found") == NONE) | (F.get("kinds", i).bitwiseAND(F.col("found")) > 0))
    blocks = F.when(F.col("kept").isNull(), plain).otherwise(F.transform("kept", lambda i: F.get("blocks", i)))
    text = F.array_join(blocks, "\n\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
