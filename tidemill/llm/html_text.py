"""Main text of web pages by composite text density.

A page is read into a tree of nodes in one pass. Parts that are never main text by their tag or role
(menus, forms, scripts and the like) are taken off. For each node that is left: characters per tag,
adjusted by the share of link characters and link tags, against the whole body's share. Names lower the
density of a block, within bounds: one that is made of words like `sidebar` or `menu` alone to a sixth or so,
one that only holds such a word (`related-work`) to a half; only what says advert, consent or readers'
comments (several of them, or their list) is lowered until nothing is left. A node's sum is that of its children's densities. The
path from the body to the node of the greatest sum gives the threshold, its least density. Named
blocks whose lowered density, links apart, stays far below the threshold are taken off, and densities and threshold
taken anew; of the nodes that reach it, the subtree with the greatest sum is the main text, widened to
the article that it lies in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Tags by how they are read, and names that mark parts which are not main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_NEVER = frozenset("script style textarea title xmp noembed noframes noscript template svg math canvas iframe object audio video map nav footer aside form select option dialog menu head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("table td th caption button object template html body".split())
_NOISE = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies respond disqus widget pagination pager login signup search skip toolbar masthead topbar copyright".split())
_STRONG = frozenset("ad ads advert advertisement adverts sponsor sponsored promo cookie cookies consent gdpr newsletter comments commentlist disqus".split())
_NEUTRAL = frozenset("box block container wrapper wrap list section area bar item items inner outer panel module unit slot top bottom left right thread form message text body".split())
_HOLDERS = frozenset("div section ul ol dl table article".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
_WHOLE = frozenset("html body main article".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(<?[^<]*)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")
#: What a name makes of a block's density: one that holds a doubtful word, one of such words alone, adverts and comments; and how far below the threshold a named block goes.
_DOUBTFUL, _NOISY, _LOST, _FAR = 0.5, 0.15, 0.002, 0.1


class _Node:
    __slots__ = ("tag", "names", "role", "hidden", "kids", "up", "chars", "tags", "link_chars", "link_tags", "density", "total", "gone", "anchor", "weight", "named", "labels", "within", "holds", "comments")

    def __init__(self, tag: str, attrs: str, up: _Node | None):
        self.tag, self.up, self.kids, self.gone, self.weight, self.named = tag, up, [], False, 1.0, False
        self.names, self.labels, self.role, self.hidden, self.comments = frozenset(), (), "", False, 0
        # the nearest article or main above, and what there is of these and of headings below
        self.within = None if up is None else up if up.tag in ("article", "main") else up.within
        self.holds = frozenset()
        if attrs and not attrs.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            self.labels = tuple(frozenset(x.lower() for x in _SPLIT.split(w) if x) for w in f"{found.get('class', '')} {found.get('id', '')}".split())
            self.names = frozenset().union(*self.labels)
            self.role = found.get("role", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def parse(html: str) -> _Node:
    """The tree; a text is a str among the kids. What stays open at the end is closed there."""
    root = at = _Node("#root", "", None)
    pos, n = 0, len(html)

    def close(tags: set | frozenset, bounds: set | frozenset) -> None:
        nonlocal at
        if not any(open_tags.get(t) for t in tags):
            return
        node = at
        while node.up is not None and node.tag not in bounds:
            if node.tag in tags:
                leave(node)
                return
            node = node.up

    def leave(node: _Node) -> None:
        """Close a node and all that is open in it."""
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.up
        open_tags[node.tag] -= 1
        at = node.up

    open_tags: dict[str, int] = {}
    while pos < n:
        m = _TOKEN.match(html, pos)
        if m is None or m.end() == pos:  # a broken tag: the rest up to the next bracket is text
            end = html.find("<", pos + 1)
            end = n if end < 0 else end
            at.kids.append(unescape(html[pos:end]))
            pos = end
            continue
        pos = m.end()
        if m[4] is not None:
            at.kids.append(unescape(m[4]))
        elif m[2] is not None:
            tag = m[2].lower()
            if m[1]:
                if open_tags.get(tag, 0) > 0:
                    node = at
                    while node.tag != tag:
                        node = node.up
                    leave(node)
                continue
            if tag in _CLOSES_P and open_tags.get("p"):
                close({"p"}, _SCOPE)
            if tag in _SIBLING:
                close(*_SIBLING[tag])
            node = _Node(tag, m[3], at)
            at.kids.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
                stop = end.start() if end else n
                node.kids.append(html[pos:stop])
                pos = html.find(">", stop) + 1 if end else n
                pos = pos or n
            elif tag not in _VOID and not (m[3] or "").endswith("/"):
                at = node
                open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _nodes(root: _Node) -> list[_Node]:
    """All nodes that aren't gone, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.gone:
            out.append(node)
            stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def _lowered(node: _Node) -> float:
    """What its names make of a block's density."""
    weight = 1.0
    for label in node.labels:
        if label & _NOISE:
            plain = all(w in _NOISE or w in _NEUTRAL or w[0].isdigit() for w in label)
            several = node.up is not None and node.up.comments > 1 and "comment" in label
            own = _DOUBTFUL if not plain else _LOST if label & _STRONG or several or node.tag == "article" and label & {"comment", "reply"} else _NOISY
            weight = min(weight, own)
    return weight


def prune(root: _Node) -> None:
    """Take off what tags and roles show to be no main text, and set the weights of named blocks."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        node.comments = sum(not isinstance(k, str) and any("comment" in w for w in k.labels) for k in node.kids)
        if node.up is not None and not (node.tag in _NEVER or node.hidden):
            own = node.holds | {node.tag} if node.tag in ("article", "main", "h1") else node.holds
            if not own <= node.up.holds:
                node.up.holds |= own
    for node in nodes:
        if node.up is None or node.up.gone or node.gone:
            node.gone = node.gone or (node.up is not None and node.up.gone)
            continue
        node.weight = node.up.weight  # what lies in a named block is lowered with it
        up = node.within
        if node.tag in _NEVER or node.hidden:
            node.gone = True
        elif node.tag in _INLINE or node.tag in _WHOLE and node.tag != "article":
            continue
        elif node.tag == "header" or "header" in node.names and up is None:
            node.gone = up is None and not node.holds & {"article", "main"}
        elif node.role in _ROLES:
            node.gone = not node.holds
        elif node.tag in _HOLDERS if up is not None or node.tag == "article" else not node.holds:
            own = _lowered(node)
            node.named = own < _DOUBTFUL
            node.weight = min(node.weight, own)


def weigh(root: _Node) -> tuple[_Node, list[_Node]]:
    """Set chars, tags, link_chars, link_tags, density (lowered by the weight) and total of each node; the body (or root) and all nodes."""
    nodes = _nodes(root)
    for node in nodes:
        node.anchor = node.tag == "a" or (node.up is not None and node.up.anchor)
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len(_BLANK.sub("", k))
                node.chars += n
                node.link_chars += n * node.anchor
            elif not k.gone:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        base = log(c / max(c - lc, 1) * lc + share * c + e)  # 1 at the least
        node.density = node.weight * c / t * log(max(c / max(lc, 1) * t / lt, 1)) / (log(base) if base > 1 + 1e-9 else 1)
    for node in nodes:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str) and not k.gone)
    return body, nodes


def threshold(body: _Node, inside: list[_Node]) -> float:
    """The least density on the path from the body to the node of the greatest sum, the first of equals."""
    node, least = max(inside, key=lambda x: x.total), float("inf")
    while node is not None and node is not body.up:
        least = min(least, node.density)
        node = node.up
    return least


def main_node(root: _Node) -> _Node:
    body, nodes = weigh(root)
    least = threshold(body, _nodes(body))
    far = [x for x in nodes if x.named and x.density * (1 - x.link_chars / max(x.chars, 1)) <= _FAR * least]
    for node in far:
        node.gone = True
    if far:
        body, _ = weigh(root)
    inside = _nodes(body)
    least = threshold(body, inside)
    best = max((x for x in inside if x.density >= least), key=lambda x: x.total, default=body)
    if best.total == 0:
        best = body
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.up
    held = [x for x in inside if x.tag in ("article", "main")]
    if len(held) == 1 and held[0].chars >= 0.5 * best.chars:
        return held[0]
    while best.up is not None and best is not body and best.tag in _INLINE | {"p", "h1", "h2", "h3", "li"}:
        best = best.up  # a block alone isn't a text: its siblings belong to it
    return best


def blocks(node: _Node) -> list[str]:
    """Texts of the blocks below a node, in order; white space within one is a space, a line break counts as white space."""
    out, held = [], []

    def flush() -> None:
        if text := _BLANK.sub(" ", "".join(held)).strip():
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not x.gone:
            if x.tag == "br":
                held.append(" ")
                continue
            if x.tag not in _INLINE:
                flush()
                stack.append(None)
            stack += reversed(x.kids)
    flush()
    return out


def extract(html: str | None) -> str:
    """The main text of a page, blocks two newlines apart; empty if there is none, or html is null."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n\n".join(blocks(main_node(root)))


def _texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in parts:
        yield pd.Series([extract(x) for x in html], dtype=object)


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages and their main text in the column `text`, row by row without an exchange.

    Null and empty html have an empty text; a page of any length is read whole, and what it leaves open
    is closed at its end. Repeated rows get the same text; of subtrees with equal sums the first counts;
    an empty table stays empty. All other columns pass through; one named as `text` says is replaced.
    """
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _texts(parts)

    return pages.withColumn(text, F.pandas_udf(texts, "string")(html))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page of `pages`."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
