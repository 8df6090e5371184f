"""Main text of web pages by composite text density.

The page becomes a tree of block elements, without elements that never hold an article (scripts,
menus, footers and the like, by tag). Every node gets a density: its characters per tag, adjusted by
how many of characters and tags belong to links; a class name or role that speaks of adverts,
comments and the like weighs it down, with all that it holds. The node whose children's densities
sum up to most is the core. The least density of the nodes of few links on the way from the body to the
core is the threshold.

From the core the article grows: to the outermost enclosing article or main of few links, or, where
there is none, up through ancestors of few links to those neighbours that reach the threshold or are
headings, paragraphs, sections, lists or tables. Elsewhere, subtrees of few links that reach the
threshold belong to the article as well. Within it, what is weighed down and stays below the
threshold is left out, and so is a form of fields and little text. Blocks are joined in page order.

Defined results: null or empty html and pages without text give an empty text; unclosed and
crossing tags are closed by their surroundings; whole pages are read whatever their length; repeated
rows give repeated rows; other columns are carried along, those named like an added one are
replaced; an empty table gives an empty result. Line breaks within a block are white space.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp noframes".split())
_DROPPED = frozenset("head script style title textarea noscript template nav footer aside button select option iframe object svg canvas audio video dialog menu xmp noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input".split())
_KEEP = frozenset("html body main article".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "disqus respond replies reply search form widget toolbar pagination pager complementary contentinfo".split()
)
_CORE = frozenset("content article main story entry body text".split())
#: What remains of densities and characters under a name that speaks against an article.
LOW = 0.05
#: Characters for each field up to which a form is a form, and not a page in a form.
FORM_CHARS = 250
_FIELDS = frozenset("input button select textarea".split())
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p section table ul ol dl blockquote pre figure hgroup details".split())
#: An element that opens one of these closes an open one of those, unless a container lies between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Share of linked characters up to which an ancestor of the core is all article.
FEW_LINKS = 0.25
_SCOPE = frozenset("ul ol dl table div section article main body aside nav footer header form blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "link_chars", "tags", "link_tags", "fields", "named", "density", "weight")

    def __init__(self, tag: str, parent: Node | None, named: bool = False):
        self.tag, self.parent, self.named = tag, parent, named
        self.kids: list[Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.fields = 0
        self.density = self.weight = 0.0
        if parent:
            parent.kids.append(self)


def boilerplate(tag: str, attributes: str) -> bool:
    """Whether a name in class, id or role says that this isn't part of an article."""
    if tag in _KEEP or tag == "form" or not attributes:
        return False
    for found in _NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = [p.lower() for p in _PART.findall(name)]
            if not parts or parts[0] in ("has", "with", "no"):
                continue
            of_article = bool(_CORE.intersection(parts))
            if parts[-1] in _BOILERPLATE and not (of_article and parts[-1] == "header") or parts[0] in _BOILERPLATE and not of_article:
                return True
    return False


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of blocks, and the texts of the blocks in page order."""
    root = Node("body", None)
    blocks: list[tuple[Node, str]] = []
    stack: list[tuple[str, Node | None, bool]] = []  # tag, block, left out
    node, out, links, in_article, text = root, 0, 0, 0, []

    def flush() -> None:
        joined = " ".join("".join(x for x, _ in text).split())
        if joined:
            node.chars += len(joined)
            node.link_chars += min(len(joined), sum(len(" ".join(x.split())) for x, linked in text if linked))
            blocks.append((node, joined))
        text.clear()

    def close(depth: int) -> None:
        nonlocal node, out, links, in_article
        while len(stack) > depth:
            tag, block, left = stack.pop()
            out -= left
            links -= tag == "a"
            in_article -= tag in ("article", "main")
            if block:
                flush()
                node = block.parent or root

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        raw = page[at : token.start() if token else end]
        if raw and not out:
            text.append((html.unescape(raw), links > 0))
        if not token:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        attributes = token[3] or token[6] or ""
        block = tag not in _INLINE
        if block:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in _CLOSES.get(tag, ()):
                    close(depth)
                elif stack[depth][0] in _SCOPE:
                    break
        named = boilerplate(tag, attributes)
        # what is no block of its own can't be weighed
        left = tag in _DROPPED or named and not block or tag == "header" and not in_article
        if not out and tag in _FIELDS and "hidden" not in attributes:
            node.fields += 1
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if not (out or left):
            node.tags += 1
            node.link_tags += tag == "a"
            if tag == "br":
                text.append(("\n", False))
        if tag in _VOID or attributes.endswith("/") and not block:
            if block:
                flush()
            continue
        if block:
            flush()
        own = None
        if block and not out and not left and tag not in ("html", "body"):
            own = node = Node(tag, node, named)
        stack.append((tag, own, left))
        out += left
        links += tag == "a"
        in_article += tag in ("article", "main")
    close(0)
    flush()
    return root, blocks


def _measure(root: Node) -> list[Node]:
    """Sums up characters and tags from the leaves and sets the densities; nodes in page order."""
    nodes, todo = [], [root]
    while todo:
        nodes.append(one := todo.pop())
        todo.extend(reversed(one.kids))
    for one in reversed(nodes):
        for kid in one.kids:
            one.chars += kid.chars
            one.link_chars += kid.link_chars
            one.tags += kid.tags
            one.link_tags += kid.link_tags
            one.fields += kid.fields
    share = root.link_chars / max(root.chars, 1)
    for one in nodes:
        if one.chars:
            plain = max(one.chars - one.link_chars, 1)
            links, tags, link_tags = max(one.link_chars, 1), max(one.tags, 1), max(one.link_tags, 1)
            base = math.log(one.chars / plain * links + share * one.chars + math.e)
            adjusted = math.log(max(one.chars / links * tags / link_tags, 1.0)) / math.log(base) if base > 1 else 1.0
            one.density = one.chars / tags * adjusted
    low: set[int] = set()
    for one in nodes:  # parents come before their children
        if one.named or one.parent and id(one.parent) in low:
            low.add(id(one))
            one.density *= LOW
    for one in reversed(nodes):
        own = one.chars - sum(k.chars for k in one.kids)
        one.weight = own * (LOW if id(one) in low else 1.0) + sum(k.weight for k in one.kids)
    return nodes


def few_links(node: Node) -> bool:
    return node.link_chars <= FEW_LINKS * node.chars


def marked(core: Node, nodes: list[Node]) -> list[Node]:
    """The article or main elements of few links that the core lies in (the outermost), or those in
    it, if they hold most of its text."""
    outer, one = None, core
    while one.parent:
        if one.tag in ("article", "main") and few_links(one):
            outer = one
        one = one.parent
    if outer:
        return [outer]
    inner, todo = [], list(core.kids)
    while todo:
        one = todo.pop()
        if one.tag in ("article", "main"):
            inner += [one] * few_links(one)
        else:
            todo.extend(one.kids)
    return inner if 2 * sum(x.weight for x in inner) > core.weight else []


def reached(core: Node, threshold: float) -> list[Node]:
    """The core, and the neighbours of its path up through ancestors of few links that belong to it."""
    tops, one = [core], core
    while one.parent and few_links(one.parent):
        for near in one.parent.kids:
            if near is not one and few_links(near) and (near.density >= threshold or near.tag in _TEXTUAL and not near.named):
                tops.append(near)
        one = one.parent
        tops.append(one)
    return tops


def main_text(page: str | None) -> str:
    """The text of the article, one line per block."""
    if not page:
        return ""
    root, blocks = parse(page)
    if not blocks:
        return ""
    nodes = _measure(root)
    core = max(nodes, key=lambda n: sum(k.density for k in n.kids))
    if not core.kids:
        core = root
    threshold, one = core.density, core
    while one.parent:
        one = one.parent
        if few_links(one):  # what menus thin out says little about text
            threshold = min(threshold, one.density)
    inside: set[int] = set()

    def take(top: Node) -> None:
        todo = [top]
        while todo:
            x = todo.pop()
            weighed_down = x.named and x is not top and x.density < threshold
            if id(x) in inside or weighed_down or x.tag == "form" and x.chars < FORM_CHARS * max(x.fields, 1):
                continue
            inside.add(id(x))
            todo.extend(x.kids)

    article = marked(core, nodes)
    for top in article or [core]:
        take(top)
    if not article:
        above = set()
        one = core
        while one.parent:
            one = one.parent
            above.add(id(one))
        for top in reached(core, threshold):
            if id(top) in above:
                inside.add(id(top))  # what it holds by itself, between its blocks
            else:
                take(top)
    # elsewhere: the highest subtrees that reach the threshold around blocks that do
    settled, highest = {id(root): False}, {}
    for x in nodes[1:]:  # parents come before their children
        up = x.parent
        settled[id(x)] = id(x) in inside or settled[id(up)]
        highest[id(x)] = highest[id(up)] if up.parent and up.density >= threshold else x
    for x in nodes[1:]:
        dense = x.chars and not x.kids and x.density >= threshold and 2 * x.link_chars <= x.chars
        if dense and not settled[id(x)] and not settled[id(highest[id(x)])]:
            take(highest[id(x)])
    return "\n".join(text for node, text in blocks if id(node) in inside)


def extract(pages: DataFrame, html_col: str = "html", drop_html: bool = False) -> DataFrame:
    """pages with `text`, the main text of each page, and `n_chars`, its code points."""
    pages = pages.drop("text", "n_chars")
    kept = [f for f in pages.schema.fields if not (drop_html and f.name == html_col)]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in kept]
    html_at, kept_at = pages.columns.index(html_col), [pages.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page.as_py()) for page in part.column(html_at)]
                columns = [part.column(k) for k in kept_at]
                columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
