"""Main text of web pages by composite text density.

A page becomes a tree.  Menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments are cut off by their tag, role, class or id.  Every
remaining node gets a link-adjusted number of characters per tag; the subtree whose
children's densities sum highest, among the nodes at least as dense as the
sparsest on the path from the densest node to the body, holds the article.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without content, elements that are blocks, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style template noscript iframe object svg math textarea title select canvas noembed noframes xmp".split())
CLOSES_P = BLOCK - frozenset("body html br caption legend option optgroup td th tr tbody thead tfoot".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tr": {"tr", "td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl body html article section div main".split())

# What is no article, by tag, role and words of class or id.
CUT_TAGS = frozenset("nav footer aside form button input select menu dialog head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice banner popup modal newsletter subscribe subscription "
    "comment comments disqus replies share sharing social related recommended widget pagination pager toolbar login signup "
    "search skip".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
# One attribute after the other: a name and its value, quoted or not, taken as a whole.
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("attrs", "chars", "children", "density", "link_chars", "link_tags", "parent", "parts", "sums", "tag", "tags")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[Node | str] = []


def parse(page: str) -> Node:
    """The page as a tree; ends are implied as browsers do, so unclosed tags do no harm."""
    root = here = Node("#root")
    at, low = 0, None
    while True:
        found = _TOKEN.search(page, at)
        text = page[at:found.start() if found else len(page)]
        if text:
            here.parts.append(entities.unescape(text) if "&" in text else text)
        if not found:
            return root
        at = found.end()
        if found.group(2) is None:
            continue
        tag = found.group(2).lower()
        if found.group(1):
            node = here
            while node.parent and node.tag != tag and not (node.tag in SCOPE and tag not in SCOPE and tag not in BLOCK):
                node = node.parent
            if node.tag == tag and node.parent:
                here = node.parent
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            node = here
            while node.parent and node.tag not in ends and node.tag not in SCOPE:
                node = node.parent
            if node.tag in ends:
                here = node.parent
                if tag == "tr" and here.tag == "tr":
                    here = here.parent
        node = Node(tag, found.group(3), here)
        here.children.append(node)
        here.parts.append(node)
        if tag in RAW:  # its content is no markup
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(page) else -1
            if end < 0:
                found = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
                end = found.start() if found else len(page)
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not found.group(3).endswith("/"):
            here = node


def boilerplate(node: Node, whole: int = 0) -> bool:
    """Is the node no part of an article, by its tag or its attributes?

    ``whole`` are the page's unlinked characters.  A form, or a node whose class or id only has a telling word as
    a part of a longer name, stays if it is a frame around the text.
    """
    if node.tag == "form":
        return not frames_text(node, whole)
    if node.tag in RAW or node.tag in CUT_TAGS:
        return True
    if node.tag == "header":
        return not inside_article(node)
    if not node.attrs or node.tag in ("body", "html", "article", "main"):
        return False
    seen = set()
    for name, a, b, c in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in CUT_ROLES:
            return True
        if name in ("class", "id"):
            names = value.lower().split()
            if not CUT_WORDS.isdisjoint(names):
                return True
            if not CUT_WORDS.isdisjoint(w for one in names for w in _SPLIT.split(one)) and not frames_text(node, whole):
                return True
    return False


def frames_text(node: Node, whole: int) -> bool:
    """Does the node hold an article, or the heading of one it is in, or half of the page's unlinked text?"""
    if 2 * node.chars >= whole > 0:
        return True
    todo, titled = [node], inside_article(node)
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main") or titled and x.tag == "h1":
            return True
        todo += x.children
    return False


def unlinked(root: Node) -> None:
    """``chars`` of every node: those of its text that stand in no link, script and the like."""
    order = [root]
    for node in order:
        order += node.children
    for node in reversed(order):
        own = 0 if node.tag in RAW or node.tag == "a" else sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        node.chars = 0 if node.tag in RAW or node.tag == "a" else own + sum(x.chars for x in node.children)


def inside_article(node: Node) -> bool:
    while node.parent:
        node = node.parent
        if node.tag in ("article", "main"):
            return True
    return False


def cut(root: Node) -> list[Node]:
    """Remove boilerplate; the remaining nodes, parents first."""
    unlinked(root)
    order, i, whole = [root], 0, root.chars
    while i < len(order):
        node = order[i]
        keep = [x for x in node.children if not boilerplate(x, whole)]
        if len(keep) < len(node.children):
            kept = set(map(id, keep))
            node.parts = [x for x in node.parts if isinstance(x, str) or id(x) in kept]
            node.children = keep
        order += keep
        i += 1
    return order


def measure(order: list[Node]) -> None:
    """Characters, tags and density of every node, and the sum over its children."""
    for node in reversed(order):
        node.chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in node.children)
        node.tags = sum(x.tags + 1 for x in node.children)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in node.children)
        node.link_tags = node.tags + 1 if link else sum(x.link_tags for x in node.children)
    whole = order[0]
    body_ratio = whole.link_chars / max(1, whole.chars)
    for node in reversed(order):
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + body_ratio * node.chars + math.e)
            inner = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(max(inner, 1e-9)) / math.log(max(base, 1.0001)))
        else:
            node.density = 0.0
        node.sums = sum(x.density for x in node.children)


def article(root: Node) -> Node:
    """The subtree that holds the main text."""
    order = cut(root)
    measure(order)
    densest = max(order, key=lambda x: x.density)
    limit, node = densest.density, densest
    while node.parent and node.tag != "body":
        node = node.parent
        limit = min(limit, node.density)
    # A frame holds blocks; a paragraph with an emphasised word is none, however dense the word.
    dense = [x for x in order if x.density >= limit and x.children]
    inside = [x for x in dense if any(c.tag in BLOCK and c.tag != "br" for c in x.children)] or dense or order
    best = max(inside, key=lambda x: (x.sums, x.chars))
    node = best
    while node:  # an enclosing article keeps its title and its sparser blocks
        if node.tag in ("article", "main") or "articlebody" in node.attrs.lower():
            best = node
            if node.tag == "article":
                break
        node = node.parent
    return best


def text_of(node: Node) -> str:
    """The blocks of a subtree in page order, white space as one space."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in BLOCK:
            out.append(" ")
            todo.append(" ")
            todo += reversed(x.parts)
        else:
            todo += reversed(x.parts)
    return " ".join("".join(out).split())


def extract(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and one without text."""
    return text_of(article(parse(page))) if page else ""


def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([extract(page) for page in batch], dtype=object)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page gives an empty text; null and repeated keys pass
    through; an empty table gives an empty result; pages of any length are read whole; other columns are ignored.
    """
    return (pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.pandas_udf(main_text, "string")(F.col(html)).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
