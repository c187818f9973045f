"""Main-text extraction by composite text density.

Each node of the document tree gets its characters per tag, lowered where much of the text
or many of the tags are links. Scripts, forms, navigation and similar elements are no part
of the tree, nor are elements whose class, id or role has a word of ``ASIDE``, unless they
hold an article or most of the text. The node whose children have the largest sum of densities holds the article;
the smallest density on its way up to the body is the threshold, and wherever a node reaches
the threshold, the subtree with the largest sum below it is part of the result.

Defined results: a null html counts as an empty one and gives an empty text; text outside
any element belongs to the body; unclosed and stray tags are mended as far as the text
needs it; repeated rows are extracted one by one; an empty table gives an empty result; only
the columns named are read.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag; a larger-than sign in quotes does not end it.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'])(?:([^\s=/"']++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(hidden)(?![^\s/>]))""")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select noframes xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Elements that never hold article text.
OUTSIDE = RAW | frozenset("head nav footer aside button menu dialog label canvas audio video map".split())
#: Elements that are judged by what they hold, as those with a word of ``ASIDE`` are.
_JUDGED = frozenset(("form", "fieldset"))
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body"}
#: An open element of the second kind is closed by a start tag of the first.
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Formatting inside a text: part of the element around it, not a node; links are counted.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Words in class, id or role that mark what is no part of an article.
ASIDE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations widget toolbar pagination pager contentinfo complementary search alert outbrain taboola".split())
_HOLDERS = frozenset(("html", "body", "main", "article"))


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool | None:
    """Whether an element is no part of the tree; None leaves it to what it holds."""
    named: bool | None = None if tag in _JUDGED else False
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if tag in _HOLDERS or not attributes:
        return named
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name in ("class", "id", "role") and not ASIDE.isdisjoint(_TOKEN.findall(value)):
            named = None
        if name in ("class", "id") and not in_article and "header" in _TOKEN.findall(value):
            named = None
    return named


class _Tree:
    """Nodes in page order: parent, tag, and counts of characters and tags below, of all and of links."""

    def __init__(self) -> None:
        self.parent, self.tag = [-1], ["body"]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        #: (node, text), or (node, None) where a block begins or ends.
        self.events: list[tuple[int, str | None]] = []
        #: Nodes whose class, id or role has a word of ``ASIDE``.
        self.named: list[int] = []

    def add(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        for x in (self.chars, self.tags, self.link_chars, self.link_tags):
            x.append(0)
        return len(self.tag) - 1


def _tokens(page: str) -> Iterator[tuple[str, str | None, str, int]]:
    """Text before a tag, the tag's name (None: a comment or declaration, or the end), what follows the name, and where the tag ends.

    The consumer sends back where to go on. Each character is looked at a bounded number of
    times, whatever is left open.
    """
    at, n, last = 0, len(page), page.rfind(">")
    while True:
        start = at
        while True:  # a smaller-than sign that begins no tag is text
            lt = page.find("<", start)
            if lt < 0 or lt > last:
                # Without a sign that ends a tag, all that follows is text, but for a comment that is left open.
                comment = page.find("<!--", at if lt < 0 else lt)
                yield page[at:] if comment < 0 else page[at:comment], None, "", n
                return
            if page.startswith("!--", lt + 1):
                end = page.find("-->", lt + 4)
                name, rest, end = None, "", n if end < 0 else end + 3
                break
            if page.startswith(("!", "?"), lt + 1):
                name, rest, end = None, "", page.find(">", lt) + 1
                break
            if m := _NAME.match(page, lt + 1):
                r = _REST.match(page, m.end())
                # A quote that is never closed hides nothing: the tag ends at the next sign.
                end = r.end() if r else page.find(">", m.end()) + 1
                name, rest = m[1] + m[2].lower(), page[m.end() : end - 1]
                break
            start = lt + 1
        at = yield page[at:lt], name, rest, end
        if at is None:
            at = end


def parse(page: str) -> _Tree:
    tree = _Tree()
    stack: list[tuple[str, int]] = [("body", 0)]
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    blocks = [0]  # where blocks are
    links, articles, skip = 0, 0, 0  # skip: depth of the stack at which set-aside content ends

    def text(raw: str) -> None:
        if not skip and raw:
            clean = entities.unescape(raw) if "&" in raw else raw
            if clean:
                node = stack[-1][1]
                size = len(_SPACE.sub(" ", clean).strip())
                tree.chars[node] += size
                if links:
                    tree.link_chars[node] += size
                tree.events.append((node, clean))

    def put(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, node))

    def close(depth: int) -> None:
        nonlocal skip, links, articles
        while len(stack) > depth:
            tag, node = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                if not skip:
                    tree.events.append((node, None))
            links -= tag == "a" and not skip
            articles -= tag in ("article", "main")
            if skip and len(stack) < skip:
                skip = 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    tokens = _tokens(page)
    before, tag, rest, at = next(tokens)
    while True:
        text(before)
        go_on = None
        if tag is None:
            if at >= len(page):
                break
        elif tag.startswith("/"):
            tag = tag[1:]
            depth = last((tag,))
            # An inline end tag does not close a block that is open inside it.
            if tag not in ("body", "html") and depth and (tag in BLOCK or blocks[-1] < depth):
                close(depth)
        elif tag in VOID:
            if not skip:
                if tag in ("br", "hr"):
                    tree.events.append((stack[-1][1], " " if tag == "br" else None))
                tree.tags[stack[-1][1]] += 1
        elif tag in ("html", "body"):
            close(1)
        elif tag in RAW and not rest.rstrip().endswith("/"):
            end = _RAW_END[tag].search(page, at)
            go_on = end.end() if end else len(page)
        else:
            if tag in _CLOSES_P and last(("p",)) > last(("table", "td", "button")):
                close(last(("p",)))
            if tag in _SIBLINGS:
                names, until = _SIBLINGS[tag]
                if last(names.split()) > last(until):
                    close(last(names.split()))
            if skip:
                put(tag, stack[-1][1])
            elif aside := _set_aside(tag, rest, articles > 0):
                if tag in BLOCK:
                    tree.events.append((stack[-1][1], None))
                put(tag, stack[-1][1])
                skip = len(stack)
            else:
                node = stack[-1][1] if tag in INLINE and aside is False else tree.add(stack[-1][1], tag)
                if aside is None:
                    tree.named.append(node)
                if tag in BLOCK:
                    tree.events.append((node, None))
                put(tag, node)
                links += tag == "a"
            articles += tag in ("article", "main")
            if tag == "a" and not skip:
                tree.tags[stack[-1][1]] += 1
                tree.link_tags[stack[-1][1]] += 1
        try:
            before, tag, rest, at = tokens.send(go_on)
        except StopIteration:
            break
    close(1)
    gone = _drop_named(tree)
    for i in range(len(tree.tag) - 1, 0, -1):
        if gone[i]:
            continue
        p = tree.parent[i]
        tree.chars[p] += tree.chars[i]
        tree.tags[p] += tree.tags[i] + 1
        tree.link_chars[p] += tree.link_chars[i]
        tree.link_tags[p] += tree.link_tags[i]
    return tree


def _drop_named(tree: _Tree) -> list[bool]:
    """Take named nodes and all below them out of the tree; says which nodes are gone.

    A named node stays if it holds a main or article. Where none of these has text, it also
    stays if it holds over twice as much text, links not counted, as there is below no named
    node; the largest is asked first.
    """
    n = len(tree.tag)
    gone = [False] * n
    if not tree.named:
        return gone
    own = [c - k for c, k in zip(tree.chars, tree.link_chars, strict=True)]
    size, holds = own[:], [tag in ("article", "main") for tag in tree.tag]
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        holds[tree.parent[i]] = holds[tree.parent[i]] or holds[i]
    named = {i for i in tree.named if not holds[i]}
    marked = any(tag in ("article", "main") and size[i] for i, tag in enumerate(tree.tag))
    if not marked:
        # The nearest named node at or above each node; 0 where there is none.
        above, below, outside = [0] * n, {i: [] for i in named}, own[0]
        tops: list[tuple[int, int]] = []
        for i in range(1, n):
            up = above[tree.parent[i]]
            above[i] = i if i in named else up
            outside += own[i] if not above[i] else 0
            if i in named:
                below[up].append(i) if up else tops.append((-size[i], i))
        heapq.heapify(tops)
        while tops and size[tops[0][1]] > 2 * outside:
            i = heapq.heappop(tops)[1]
            named.discard(i)
            outside += size[i] - sum(size[k] for k in below[i])
            for k in below[i]:
                heapq.heappush(tops, (-size[k], k))
    for i in range(1, n):
        gone[i] = i in named or gone[tree.parent[i]]
    for i in range(1, n):
        if gone[i]:
            tree.chars[i] = tree.tags[i] = tree.link_chars[i] = tree.link_tags[i] = 0
    # Where a block was taken out, the text around it still does not run on.
    tree.events = [(i, x) for i, x in tree.events if not gone[i] or (x is None and i in named and tree.tag[i] in BLOCK)]
    return gone


def densities(tree: _Tree) -> list[float]:
    """Composite text density: characters per tag, times a logarithm whose base grows with the share of link text."""
    body_ratio = tree.link_chars[0] / max(1, tree.chars[0])
    out = []
    for c, t, lc, lt in zip(tree.chars, tree.tags, tree.link_chars, tree.link_tags, strict=True):
        t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
        if not c:
            out.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
        out.append(c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.000001)) if base > 1 else c / t)
    return out


def content_nodes(tree: _Tree) -> list[bool]:
    """Which nodes lie in the result."""
    n, density = len(tree.tag), densities(tree)
    total = [0.0] * n
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    best = max(range(n), key=lambda i: (total[i], -i))
    if not total[best]:  # no element has text: the body's own text is all there is
        return [True] * n
    at, threshold = best, density[best]
    while at > 0:
        at = tree.parent[at]
        threshold = min(threshold, density[at])
    # The subtree with the largest sum below each node, itself included.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if (total[top[i]], -top[i]) > (total[top[p]], -top[p]):
            top[p] = top[i]
    inside = [False] * n
    for i in range(n):
        if density[i] >= threshold and density[i] > 0:
            inside[top[i]] = True
    for i in range(1, n):
        inside[i] = inside[i] or inside[tree.parent[i]]
    # A heading of the article that holds the best node belongs to it.
    at, holders = best, set()
    while at > 0:
        if tree.tag[at] in ("article", "main"):
            holders.add(at)
        at = tree.parent[at]
    for i in range(1, n):
        if tree.tag[i] in ("h1", "h2") and tree.parent[i] in holders:
            inside[i] = True
        elif inside[tree.parent[i]]:
            inside[i] = True
    return inside


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    tree = parse(page)
    inside = content_nodes(tree)
    blocks, parts = [], []
    for node, piece in [*tree.events, (0, None)]:
        if piece is None:
            if block := _SPACE.sub(" ", "".join(parts)).strip():
                blocks.append(block)
            parts = []
        elif inside[node]:
            parts.append(piece)
    return "\n\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for each row of ``pages``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the ``op4_html_extraction`` query."""
    return main_text(pages)
