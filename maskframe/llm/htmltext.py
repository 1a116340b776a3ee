"""Main text of web pages, with what a site's pages have in common removed.

1. Every page is parsed to a tree; each element's subtree gets a hash of its tags and its white-space-free text.
2. Spark counts, for each host, with how many distinct articles a subtree occurs: pages whose text by step 4, before any
   count, is the same are copies, and count once however many they are.
3. Subtrees that recur with at least ``PAGES`` articles and with ``SHARE`` of a host's articles are its template and are deleted,
   as are elements that say themselves that they aren't content (menus, headers, footers, sidebars, notices, adverts,
   forms, comments, scripts and so on: by tag, role, or a class or id that names such a box; but in an article no class
   or id deletes headings, paragraphs, items or cells, or what is inline in them). Inside a page's article only blocks
   that are no paragraph, heading, list or table of it are open to the count, or ones with ``ARTICLE_SHARE`` of the
   articles; inline elements aren't. Without an article, neither are paragraphs, headings, and what is inline in text.
4. What is left of the article elements (else of main, else of the body) is its blocks' text: character references
   decoded, runs of white space as one space, trimmed, empty blocks left out, joined by a newline in page order.

A null page or url: empty text, and an unnamed host. Pages that repeat an id are pages of their own. Hosts are
lower-cased, without port or user. Malformed markup never fails: stray end tags are ignored, open elements end with
their parents, a paragraph ends where the next block begins, and a tag or quoted value that never ends takes the rest of
the page with it, as in browsers. Parsing is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PAGES, SHARE, ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.3, 10, 0.8
#: Up to so many (host, hash) rows a template table is broadcast; a larger one is joined over salted hosts.
BROADCAST_ROWS, SALTS = 500_000, 32

# HTML element names by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav aside footer form script style noscript template textarea title iframe object embed applet svg canvas button select option datalist dialog menu head audio video map input label fieldset noembed noframes math".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption article main section body html".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
TEXT = PROSE | frozenset("li dt dd td th figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id that mark what isn't the article, and words that only say what kind of box it is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar "
    "aside widget footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments respond reply replies disqus discussion form search skip legal copyright disclaimer".split()
)
BOXES = frozenset(
    "area bar block body bottom box button buttons card container content desktop global group holder icons inner item items js left links list listing mobile outer page panel primary "
    "right row secondary section site slot text thread top unit wrap wrapper".split()
)
# Ids of sections that are never made from a heading's words.
READERS = frozenset("comments respond disqus_thread".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)[\s/]*+(>?)")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?+[\s/]*+")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("block", "children", "hash", "marked", "tag")

    def __init__(self, tag: str, block: str, marked: bool):
        self.tag, self.block, self.marked, self.children, self.hash = tag, block, marked, [], 0


def _is_mark(name: str) -> bool:
    """Whether a class or id names such a box: words of ``MARKS``, and nothing but those and ``BOXES``."""
    words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in BOXES for w in words)


def _marked(tag: str, attributes: dict[str, str], inside: bool, block: str) -> bool:
    """Whether an element says itself that it isn't content; ``inside`` an article, ``block`` being the block around it.

    In an article class and id say nothing about headings, paragraphs, lists' items, cells and what is inline in them, and
    ids of sections mean headings mostly.
    """
    if tag in DROP:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").strip().lower() in ROLES:
        return True
    if tag in ("html", "body", "main") or (inside and (tag in TEXT or (tag not in BLOCK and block in TEXT))):
        return False
    if any(map(_is_mark, attributes.get("class", "").split())):
        return True
    own = attributes.get("id", "").strip()
    if tag in PROSE or (inside and tag == "section"):
        return own in READERS
    return _is_mark(own)


class _Open:
    """The elements open at a place, with where each name and each block stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the element at this place and all in it; every element is closed once, so this is linear over a page."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags, at: int) -> int | None:
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, at)) < len(p)]
        return min(found, default=None)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place inside a tag, by HTML's own states, and where the tag ends (after the page: it never does)."""
    out: dict[str, str] = {}
    while at < len(page) and page[at] != ">":
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if (m[2] is not None and not m[3]) or (m[4] is not None and not m[5]):
            return out, len(page) + 1
        value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6]
        out.setdefault(m[1].lower(), html.unescape(value) if value else "")
    return out, at + 1


def parse(page: str) -> Node:
    """The page's tree. Time is linear in the page, whatever is left open or closed twice; a tag that never ends is no text."""
    root = Node("#root", "", False)
    open_, at, end = _Open(root), 0, len(page)
    while at < end:
        here = open_.nodes[-1]
        k = page.find("<", at)
        if k < 0:
            here.children.append(page[at:])
            break
        m = TAG.match(page, k)
        if m is None:
            kind = page[k + 1 : k + 2]
            if kind not in ("!", "?", "/") or (kind == "/" and k + 2 >= end):  # a sign, not a tag
                here.children.append(page[at : k + 1])
                at = k + 1
                continue
            if k > at:
                here.children.append(page[at:k])
            if page.startswith("<!--", k):
                if page.startswith(("<!-->", "<!--->"), k):
                    at = page.index(">", k) + 1
                else:
                    stop = page.find("-->", k + 4)
                    at = stop + 3 if stop >= 0 else end
            elif page.startswith("<![CDATA[", k):
                stop = page.find("]]>", k)
                here.children.append(html.escape(page[k + 9 : stop if stop >= 0 else end]))
                at = stop + 3 if stop >= 0 else end
            else:
                stop = page.find(">", k)
                at = stop + 1 if stop >= 0 else end
            continue
        if k > at:
            here.children.append(page[at:k])
        tag, at = m[2].lower(), m.end()
        attributes: dict[str, str] = {}
        if not m[3]:
            attributes, at = _attributes(page, at)
            if at > end:
                break
        if m[1]:
            if open_.places.get(tag):
                open_.cut(open_.places[tag][-1])
            continue
        if tag in BLOCK and open_.nodes[open_.blocks[-1]].tag == "p":  # an open paragraph, with what is open in it, ends here
            open_.cut(open_.blocks[-1])
        if tag in CLOSES:
            first = open_.first_after(CLOSES[tag], open_.last(SCOPE[tag]))
            if first is not None:
                open_.cut(first)
        block = open_.nodes[open_.blocks[-1]].tag
        new = Node(tag, block, _marked(tag, attributes, bool(open_.places.get("article")), block))
        open_.nodes[-1].children.append(new)
        closed = page[at - 2] == "/"
        if tag in RAW and not closed:
            stop = CLOSING[tag].search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not closed:
            open_.push(new)
    return root


def hashed(root: Node) -> list[Node]:
    """All elements below ``root``, children first, with their subtrees' hashes (0: no text in it)."""
    import xxhash

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if c.__class__ is Node)
    for node in reversed(order):
        if node.tag in RAW:
            continue
        h, some = xxhash.xxh3_64(node.tag), False
        for c in node.children:
            if c.__class__ is Node:
                if c.hash:
                    h.update(c.hash.to_bytes(8, "little"))
                    some = True
            elif not c.isspace():
                h.update("".join(c.split()))
                some = True
        node.hash = (h.intdigest() or 1) if some else 0
    return order[:0:-1]


def _articles(root: Node, tag: str) -> list[Node]:
    """Outermost elements of this name that don't say they are something else."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.marked:
            continue
        if node.tag == tag:
            out.append(node)
            continue
        stack.extend(c for c in reversed(node.children) if c.__class__ is Node)
    return out


def _open(node: Node, template: set[int], common_most: set[int], inside: bool) -> bool:
    """Whether the count alone deletes an element."""
    if node.hash not in template and node.hash not in common_most:
        return False
    if node.tag not in BLOCK:
        return not inside and node.block not in TEXT
    return node.hash in common_most or node.tag not in (CONTENT if inside else PROSE)


def main_text(page: str, template: set[int], common_most: set[int]) -> str:
    """The page's text without ``template`` subtrees (inside articles: without those of ``common_most``)."""
    root = parse(page)
    hashed(root)
    return _text(root, template, common_most)


def _text(root: Node, template: set[int] = frozenset(), common_most: set[int] = frozenset()) -> str:
    tops, inside = _articles(root, "article"), True
    if not tops:
        tops = _articles(root, "main")
    if not tops:
        tops, inside = [root], False
    blocks: list[list[str]] = [[]]

    def walk(node: Node) -> None:
        stack: list = [(node, 0)]
        while stack:
            node, k = stack.pop()
            if k == 0 and node.tag in BLOCK:
                blocks.append([])
            while k < len(node.children):
                c = node.children[k]
                k += 1
                if c.__class__ is not Node:
                    blocks[-1].append(c)
                    continue
                if c.tag == "br":
                    blocks[-1].append(" ")
                    continue
                if c.marked or (c.tag == "header" and not inside):
                    if c.tag in BLOCK:
                        blocks.append([])
                    continue
                if _open(c, template, common_most, inside):
                    if c.tag in BLOCK:
                        blocks.append([])
                    continue
                stack.append((node, k))
                stack.append((c, 0))
                break
            else:
                if node.tag in BLOCK:
                    blocks.append([])

    for top in tops:
        blocks.append([])
        walk(top)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url_col: str):
    """The url's host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, hash, most): subtrees of a host's template; ``most`` for those with nearly all of its articles."""

    def run(batches):
        import xxhash

        for batch in batches:
            host, hashes, articles = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(page.as_py() or "")
                own = {n.hash for n in hashed(root)} - {0}
                own.add(0)  # stands for the page itself
                host += [h] * len(own)
                hashes += own
                articles += [xxhash.xxh3_64_intdigest(_text(root).encode("utf-8", "surrogatepass"))] * len(own)
            numbers = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hashes, articles))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *numbers], ["host", "hash", "article"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, "host string, hash long, article long").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    found = common.written(found, "subtrees")
    counts = found.where("hash <> 0")
    totals = found.where("hash = 0").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    return counts.join(totals, F.col("host") == F.col("h")).where(F.col("n") >= SHARE * F.col("pages")).select("host", "hash", ((F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))).alias("most"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", name: str = "text") -> DataFrame:
    """``pages`` with the main text instead of the html column."""
    found = common.written(templates(pages, html_col, url_col), "templates")
    by_host = found.groupBy("host").agg(F.collect_list("hash").alias("template"), F.collect_list(F.when(F.col("most"), F.col("hash"))).alias("most"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col])
    rows = pages.select(row.alias("row"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    if found.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(by_host.withColumnRenamed("host", "h")), F.col("host") == F.col("h"), "left")
    else:
        salted = by_host.select(F.col("host").alias("h"), "template", "most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")

    def run(batches):
        kept: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for host, page, template, most in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if host not in kept:
                    if len(kept) > 10_000:
                        kept.clear()
                    kept[host] = tuple({x & (2**64 - 1) for x in t or () if x is not None} for t in (template, most))
                out.append(main_text(page or "", *kept[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    kind = joined.select("row").schema.fields
    got = joined.select("row", "host", "html", "template", "most").mapInArrow(run, T.StructType([*kind, T.StructField("text", T.StringType())]))
    name = common.unused(pages.drop(html_col), name)
    return got.select("row.*", F.col("text").alias(name))


def op4_html_text(spark, sf_dir) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
