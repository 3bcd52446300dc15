"""HTML extraction by composite text density.

A page becomes a tree in which every element is a node. A node has C characters and T
tags below it, and LC and LT of these in links; its density is its characters per tag,
adjusted for links:

    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e^2)

(zeros count as 1; Cb and LCb are the body's; e^2 keeps b above 1). A node's sum is that
of its children's densities. The node of the largest sum sets the threshold, the least density
on the way from the body to it; among nodes of at least that density, the one of the
largest sum is the main text's subtree. It widens to the article or main element around
it; without one, to its parent while elements of the same name beside it reach the
threshold too, as the sections of one text do.

Elements that are by their name or role no part of an article are left out: they count
to the characters and tags around them, but not to the sums. So are block elements whose
class or id names them as such as a whole (all parts of one of its words do); but not if
they hold an article or main element, or most of the unlinked text while no article or
main element stands beside them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import base

INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
LEFT_OUT = RAW | frozenset("head nav footer aside form button select datalist svg math canvas object audio video dialog menu map fieldset".split())
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist disqus reply replies nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login widget toolbar pagination pager skip".split()
)
#: What else a word of class or id can be made of that has one of NAMES in it.
BESIDE = frozenset("site page top bottom left right main global primary secondary box bar area section list block slot unit wrapper wrap container inner outer post posts user reader form links buttons item items thread row col".split())
#: A start tag of the first ends an open element of the second, up to the third.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)), "a": (("a",), ("table", "td", "th", "li", "div"))}
P_SCOPE = frozenset("html body article aside section main div table td th li dd dt caption button form blockquote figure header footer nav".split())

#: What may stand in a head; anything else ends it.
HEAD = frozenset("title meta link script style base noscript template".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[A-Za-z][^\s/>]*+)(?P<rest>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?P<shut>>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
PART = re.compile(r"[a-z0-9]+")
#: Elements whose text goes on in the line around them.
IN_LINE = INLINE | RAW | VOID - {"br", "hr"} | {"a"}


class Node:
    __slots__ = ("tag", "parent", "children", "items", "why", "main", "link", "chars", "tags", "link_chars", "link_tags", "plain", "mains", "around", "density", "total")

    def __init__(self, tag: str, parent: Node | None, why: int = 0, main: bool = False):
        self.tag, self.parent, self.why, self.main = tag, parent, why, main
        self.around = main + (parent.around if parent is not None else 0)  # article or main elements it stands in
        self.link = tag == "a" or parent is not None and parent.link
        self.children: list[Node] = []
        self.items: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = self.mains = 0
        self.density = self.total = 0.0
        if parent is not None:
            parent.children.append(self)
            parent.items.append(self)


#: Why an element is left out: not at all, by its class or id alone, or by what it is.
KEPT, NAMED, OUT = range(3)


def _named(words: str) -> bool:
    for word in words.split():
        parts = PART.findall(word)
        if not NAMES.isdisjoint(parts) and all(x in NAMES or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _left_out(tag: str, rest: str, in_main: bool) -> tuple[int, bool]:
    """(why an element is no part of an article, whether it is by name or attributes the main one)."""
    if tag in LEFT_OUT or tag == "header" and not in_main:
        return OUT, False
    main = tag in MAIN
    if "=" not in rest:
        return OUT if not main and "hidden" in rest.lower().split() else KEPT, main
    have = {}
    for m in ATTRIBUTE.finditer(rest):
        have.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    role = have.get("role", "")
    if main or role in ("main", "article") or have.get("itemprop") == "articlebody":
        return KEPT, True
    bare = ATTRIBUTE.sub(" ", rest).lower().split()
    hidden = "hidden" in bare or "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "")
    if hidden or role in ROLES:
        return OUT, False
    named = tag not in INLINE and tag not in ("a", "header") and _named(have.get("class", "") + " " + have.get("id", ""))
    return NAMED if named else KEPT, False


class _Open:
    """The open elements; where the last one of a name stands is found without a search."""

    def __init__(self, body: Node):
        self.nodes = [body]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]  # places of P_SCOPE
        self.mains = 0

    def last(self, *tags: str) -> int:
        """Place of the last open element of these names, 0 for none."""
        return max((at[-1] for tag in tags if (at := self.at.get(tag))), default=0)

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in P_SCOPE:
            self.scopes.append(k)
        self.mains += node.main

    def close(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if self.scopes[-1] == len(self.nodes):
                self.scopes.pop()
            self.mains -= node.main


def parse(html: str) -> Node:
    """The tree of a page, in time linear in its length."""
    body = Node("body", None)
    stack = _Open(body)
    at, n = 0, len(html)

    def text(piece: str) -> None:
        stack.nodes[-1].items.append(unescape(piece) if "&" in piece else piece)

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            k = stack.last(tag)
            if k:
                stack.close(k)
            elif tag == "p":
                Node("p", stack.nodes[-1])
        elif m["start"] and m["shut"]:  # a tag that never ends is none
            tag, rest = m["start"].lower(), m["rest"]
            if "head" in stack.at and tag not in HEAD and (k := stack.last("head")):
                stack.close(k)
            if tag in ("html", "body"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
                Node(tag, stack.nodes[-1], OUT)
                continue
            if tag in P_ENDS and (k := stack.last("p")) > stack.scopes[-1]:
                stack.close(k)
            if tag in SAME_ENDS:
                ends, scope = SAME_ENDS[tag]
                if (k := stack.last(*ends)) > stack.last(*scope):
                    stack.close(k)
            if tag in VOID or rest.endswith("/") and tag in INLINE:
                Node(tag, stack.nodes[-1])
                continue
            stack.push(Node(tag, stack.nodes[-1], *_left_out(tag, rest, stack.mains > 0)))
    return body


def _weigh(body: Node) -> list[Node]:
    """All nodes, parents first, with their counts, densities and sums."""
    nodes, todo = [], [body]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed(node.children)
    for node in reversed(nodes):
        own = sum(len(w) for x in node.items if isinstance(x, str) for w in x.split())
        node.chars += own
        node.plain += 0 if node.link else own
        node.mains += node.main
        if node.link:
            node.link_chars, node.link_tags = node.chars, node.tags
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + node.link
            if node.why != OUT:
                up.plain += node.plain
                up.mains += node.mains
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            root = math.log(c / max(1, c - lc) * lc + share * c + math.e**2)
            node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / math.log(root)
    for node in nodes:
        # a name is no reason against what holds the article, or most of the text with none beside
        if node.why == NAMED and (node.mains or 2 * node.plain > body.plain and body.mains == node.around):
            node.why = KEPT
    kept: list[Node] = []
    for node in nodes:
        if node.why or node.parent is not None and node.parent.why:
            node.why = node.why or OUT
        else:
            kept.append(node)
    for node in kept:
        node.total = sum(x.density for x in node.children if not x.why)
    return kept


def main_node(body: Node) -> Node:
    nodes = _weigh(body)
    top = max(nodes, key=lambda x: x.total)
    if not top.total:
        return body
    threshold, x = top.density, top
    while x.parent is not None:
        x = x.parent
        threshold = min(threshold, x.density)
    best = max((x for x in nodes if x.density >= threshold), key=lambda x: x.total, default=top)
    x = best
    while x is not None and not x.main:
        x = x.parent
    if x is not None:
        return x
    while best.parent is not None and any(y is not best and y.tag == best.tag and not y.why and y.total and y.density >= threshold for y in best.parent.children):
        best = best.parent
    return best


def text_of(node: Node) -> str:
    """Its text in page order: white space inside a block is one space, blocks are joined by one."""
    pieces: list[str] = []
    todo: list[str | Node] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
        else:
            space = [] if x.tag in IN_LINE else [" "]
            todo += [*space, *([] if x.why else reversed(x.items)), *space]
    return " ".join("".join(pieces).split())


def extract(html: str | None) -> str:
    """The main text of a page; empty for null, empty and text-free ones."""
    return text_of(main_node(parse(html))) if html else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id long, url string, html string, ...) -> (page_id, url, text, n_chars),
    a row per page: the main text of the whole html, with character references decoded,
    and its code points. Null, empty and text-free html give an empty text. Other
    columns are ignored; repeated rows are treated alike; no rows give no rows.
    """
    base.tune(pages.sparkSession)
    return base.mapped(base.lean(pages, "page_id", "url", "html"), _run, "page_id long, url string, text string, n_chars long")
