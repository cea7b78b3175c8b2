"""A forgiving HTML reader: the tree of block elements of a page, its text in blocks, and node features."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |<(?P<odd_end>/?)(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without end, whose content is no text, and that stand inside lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("head svg select option button datalist canvas audio video map annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation "
    "annotation-xml".split()
)
# A start tag of the key ends an open element of the values.
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# What class, id and role tokens and element names say; each group is one feature.
TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip tabs tab topbar toolbar",
    "header": "header masthead banner top branding logo head",
    "footer": "footer foot bottom copyright colophon contentinfo legal imprint",
    "side": "sidebar side aside rail complementary widget widgets related recommended recommendations trending popular more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner affiliate",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay dialog privacy warning toast newsletter paywall message",
    "form": "form search login signup subscribe subscription register contact input field",
    "comment": "comment comments reply replies disqus discussion respond feedback review reviews thread",
    "share": "share sharing social follow tweet facebook twitter",
    "main": "article content main post entry story body text page blog prose maintext maincontent articlebody",
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKEN_GROUPS.values()):
    for _word in _words.split():
        _GROUP_OF.setdefault(_word, []).append(_i)
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "td", "body", "blockquote", "figure", "span", "heading", "other")
_TAG_CODE = {t: i for i, t in enumerate(TAGS)}
_HEADING = re.compile(r"h[1-6]$")
FEATURES = 2 * len(TAGS) + 3 * len(TOKEN_GROUPS) + 17


@dataclass
class Page:
    """Block elements in page order (a parent before its children) and text pieces ``(block, node, text, in a link)``."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    tokens: list[frozenset[int]] = field(default_factory=lambda: [frozenset()])
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)


def _token_groups(attributes: str) -> frozenset[int]:
    found: set[int] = set()
    for match in _ATTRIBUTE.finditer(attributes):
        for part in _PART.findall(match[2] or match[3] or match[4] or ""):
            found.update(_GROUP_OF.get(part.lower(), ()))
    return frozenset(found)


def parse(html: str) -> Page:
    """The tree of a page; unclosed, misnested and cut-off markup never raises."""
    page = Page()
    # Open elements: name, node, whether text inside is shown.
    stack: list[tuple[str, int, bool]] = [("html", 0, True)]
    # Where in it the elements of each name stand, so nothing has to be searched however deep a page is.
    places: dict[str, list[int]] = {"html": [0]}

    def finish(depth: int) -> tuple[bool, int]:
        """Ends all elements from ``depth`` on: whether there was a block, and how many links."""
        blocks, ended = False, 0
        for name, _, _ in stack[depth:]:
            places[name].pop()
            blocks |= name not in INLINE
            ended += name == "a"
        del stack[depth:]
        return blocks, ended

    def nearest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    at, block, links = 0, 0, 0
    while at < len(html):
        match = _TOKEN.search(html, at)
        begin = match.start() if match else len(html)
        if begin > at and stack[-1][2]:
            page.pieces.append((block, stack[-1][1], unescape(html[at:begin]), links > 0))
        if not match:
            break
        at = match.end()
        name = (match["name"] or match["odd"] or "").lower()
        if not name:
            continue
        if match["end"] or match["odd_end"]:
            if depth := nearest({name}):
                blocks, ended = finish(depth)
                block, links = block + blocks, links - ended
            continue
        attributes = match["attributes"] or ""
        if name in VOID:
            if name == "br":
                if stack[-1][2]:
                    page.pieces.append((block, stack[-1][1], " ", False))
            elif name == "hr":
                block += 1
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        inline = name in INLINE
        if not inline:
            block += 1
            closing, scope = _ENDS_ITSELF.get(name, {"p"}), _SCOPE.get(name, {"article", "section", "div", "td", "blockquote", "body"})
            if (depth := nearest(closing)) and depth >= nearest(scope):
                links -= finish(depth)[1]
        node = stack[-1][1]
        groups = _token_groups(attributes) if attributes.strip() else frozenset()
        shown = stack[-1][2] and name not in SILENT
        if name == "body" or name == "html":
            shown = True
        if (not inline or (groups and name != "a")) and name not in ("html",):
            page.tags.append(name)
            page.parents.append(node)
            page.tokens.append(groups)
            node = len(page.tags) - 1
        links += name == "a"
        if not attributes.rstrip().endswith("/") or name in INLINE or name in _TAG_CODE:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, node, shown))
    return page


def tag_code(tag: str) -> int:
    return _TAG_CODE.get("heading" if _HEADING.match(tag) else tag, _TAG_CODE["other"])


_TAG_GROUP = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 6, "dialog": 5, "article": 9, "main": 9}


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of every node, and the characters of text that it holds itself."""
    n = len(page.tags)
    parents = page.parents
    own, linked, marks, words, shown = ([0] * n for _ in range(5))
    for _, node, text, link in page.pieces:
        size = len(text) - text.count(" ")
        own[node] += size
        linked[node] += size if link else 0
        marks[node] += text.count(".") + text.count(",")
        words[node] += len(text.split())
        shown[node] += size > 0
    total, total_linked, total_marks, total_words, nodes, blocks, lists, fields = (
        list(own), list(linked), list(marks), list(words), [1] * n, [int(s > 0) for s in shown], [0] * n, [0] * n)
    children: list[int] = [0] * n
    heights = [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        lists[i] += page.tags[i] == "li"
        fields[i] += page.tags[i] in ("form", "fieldset", "label")
        for values in (total, total_linked, total_marks, total_words, nodes, blocks, lists, fields):
            values[p] += values[i]
        children[p] += 1
        heights[p] = max(heights[p], heights[i] + 1)
    out = np.zeros((n, FEATURES), np.float32)
    groups = len(TOKEN_GROUPS)
    depth, inherited, order, seen = [0] * n, [frozenset()] * n, [0] * n, 0
    born = [0] * n
    below: list[set[int]] = [set() for _ in range(n)]
    said = [page.tokens[i] | ({_TAG_GROUP[t]} if (t := page.tags[i]) in _TAG_GROUP else set()) for i in range(n)]
    for i in range(n - 1, 0, -1):
        below[parents[i]] |= below[i] | said[i]
    whole, T = max(1, total[0]), len(TAGS)
    for i in range(n):
        p = parents[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            inherited[i] = inherited[p] | said[p]
            born[i] = order[p]
            order[p] += 1
        row = out[i]
        row[tag_code(page.tags[i])] = 1
        row[T + (tag_code(page.tags[p]) if p >= 0 else T - 1)] = 1
        for g in said[i]:
            row[2 * T + g] = 1
        for g in inherited[i]:
            row[2 * T + groups + g] = 1
        for g in below[i]:
            row[2 * T + 2 * groups + g] = 1
        size = max(1, total[i])
        siblings = children[p] if p >= 0 else 1
        row[2 * T + 3 * groups :] = (
            depth[i], siblings, born[i] / max(1, siblings), children[i], heights[i], np.log1p(total[i]), np.log1p(own[i]),
            total[i] / whole, seen / whole, total_linked[i] / size, total_marks[i] / max(1, total_words[i]), total[i] / nodes[i],
            total_words[i] / max(1, blocks[i]), lists[i] / nodes[i], fields[i] / nodes[i], blocks[i], total[p] / whole if p >= 0 else 1,
        )
        seen += own[i]
    return out, np.array(own)


def block_text(page: Page, kept: np.ndarray) -> str:
    """Text of the kept nodes: white space as one space, blocks joined by an empty line."""
    blocks: list[str] = []
    current, parts = -1, []
    for block, node, text, _ in page.pieces:
        if block != current:
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            current, parts = block, []
        if kept[node]:
            parts.append(text)
    if line := " ".join("".join(parts).split()):
        blocks.append(line)
    return "\n\n".join(blocks)
