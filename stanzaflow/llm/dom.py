"""A small HTML reader: block elements and text blocks of a page, with the numbers trees decide on."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

# every alternative ends at the end of the page at the latest, so no reading starts twice at one place
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)")
_VALUE = re.compile(r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
_TAG_END = re.compile(r"[\s/]*(?:>|\Z)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title noscript iframe template svg math object canvas audio video map select option textarea button datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption legend".split())
ENDS = {  # a start tag ends an open element of these kinds, up to a border
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
CONTROLS = frozenset("input select textarea button label option".split())

TAG_GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog"}, {"form", "fieldset", "search", "legend"},
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"div", "section", "center", "details"}, {"body", "html"}, {"#text"},
]
TOKEN_GROUPS = [
    {"article", "post", "entry", "story", "hentry", "blog"}, {"content", "text", "body", "main", "page"}, {"title", "headline"},
    {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip", "tabs"},
    {"header", "masthead", "topbar", "banner", "logo", "branding", "toolbar"}, {"footer", "copyright", "contentinfo", "legal", "colophon", "imprint"},
    {"sidebar", "aside", "widget", "widgets", "complementary", "rail", "secondary"},
    {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "dfp", "adslot", "adbox"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "notification", "popup", "modal", "dialog", "overlay", "warning", "disclaimer", "message"},
    {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "commentlist", "reviews", "feedback"},
    {"share", "sharing", "social", "follow", "like", "tweet", "facebook", "twitter"}, {"related", "recommended", "recommendations", "more", "popular", "trending", "teaser", "links", "also"},
    {"form", "search", "login", "signup", "subscribe", "newsletter", "register", "input"}, {"meta", "author", "byline", "date", "tags", "tag", "category", "categories", "info"},
]
_GROUP_OF = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}
_TOKENS_OF = {token: k for k, tokens in enumerate(TOKEN_GROUPS) for token in tokens}
_BOILER_TAGS = frozenset("nav menu header footer aside form dialog search".split())
_BOILER_TOKENS = frozenset(range(3, 13))
N_FEATURES = len(TAG_GROUPS) + len(TOKEN_GROUPS) + 22


class Node:
    """A block element, or a run of text beside block elements (tag ``#text``)."""

    __slots__ = ("tag", "tokens", "parent", "children", "depth", "runs", "link", "truth", "order", "controls", "length", "link_length", "paragraphs", "items", "stops", "place", "alike")

    def __init__(self, tag: str, tokens: frozenset[int], parent: Node | None, truth: int | None = None):
        self.tag, self.tokens, self.parent, self.truth = tag, tokens, parent, truth
        self.children: list[Node] = []
        self.runs: list[str] = []
        self.link = self.controls = self.place = 0
        self.alike = 1
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)

    def text(self) -> str:
        return " ".join("".join(self.runs).split())


_NO_TOKENS: frozenset[int] = frozenset()


def _attributes(html: str, at: int) -> tuple[int, frozenset[int], str | None, bool]:
    """What follows a tag's name: the place behind the tag, the groups of its tokens, its truth, and whether ``/`` ends it.

    A value in quotes may hold ``>``; a quote that is never closed is an ordinary character.
    """
    found, truth = _NO_TOKENS, None
    while not (done := _TAG_END.match(html, at)):
        m = _NAME.match(html, at)
        key, at = m[1].lower(), m.end()
        m = _VALUE.match(html, at)
        value = ""
        if m:
            value, at = m[1] or m[2] or m[3] or "", m.end()
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            found |= {_TOKENS_OF[w] for w in map(str.lower, _WORD.findall(value)) if w in _TOKENS_OF}
        elif key == "data-truth":
            truth = value
    return done.end(), found, truth, html[done.start() : done.end()].rstrip(">").endswith("/")


class _Open:
    """The open elements: (tag, node that holds their text, hidden, link), found by tag without a search."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node, bool, bool]] = [("html", root, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, node: Node, hidden: bool, link: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, hidden, link))

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_to(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > max(1, place):
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def parse(html: str) -> Node:
    """The tree of block elements of a page; text lies in leaves.  Time is linear in the page, whatever its markup."""
    root = Node("html", _NO_TOKENS, None)
    opened = _Open(root)
    stack = opened.stack
    text_at: dict[int, Node] = {}
    at, end = 0, len(html)

    def put(raw: str) -> None:
        tag, node, hidden, link = stack[-1]
        if hidden or not raw:
            return
        run = unescape(raw) if "&" in raw else raw
        if node.children:  # text beside blocks becomes a leaf of its own
            last = node.children[-1]
            if text_at.get(id(node)) is not last:
                if run.isspace():
                    return
                last = Node("#text", _NO_TOKENS, node)
                text_at[id(node)] = last
            node = last
        node.runs.append(run)
        if link:
            node.link += len(run.strip())

    def open_block(tag: str, tokens: frozenset[int], truth: str | None) -> Node:
        holder = stack[-1][1]
        if holder.runs:  # the text so far stands beside a block now
            moved = Node("#text", _NO_TOKENS, holder)
            moved.runs, holder.runs, moved.link, holder.link = holder.runs, [], holder.link, 0
            if not "".join(moved.runs).strip():
                holder.children.pop()
        text_at.pop(id(holder), None)
        return Node(tag, tokens, holder, {"0": 0, "1": 1}.get(truth))

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        at, tokens, truth, closed = _attributes(html, at)
        if m["end"]:
            place = opened.last(tag)
            if place and (tag in BLOCK or place > opened.blocks[-1]):  # an inline end tag doesn't end blocks
                holder = stack[place - 1][1]
                opened.close_to(place)
                if tag in BLOCK:
                    text_at.pop(id(holder), None)
            continue
        if tag == "html" or tag == "body" and opened.last("body"):
            continue
        if tag in CLOSES_P and stack[opened.blocks[-1]][0] == "p":
            opened.close_to(opened.blocks[-1])
        if tag in ENDS:
            kinds, borders = ENDS[tag]
            place = opened.last(*kinds)
            if place > opened.last(*borders):
                opened.close_to(place)
        _, node, hidden, link = stack[-1]
        if tag in CONTROLS:
            node.controls += 1
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                put(" " if tag != "wbr" else "")
                if tag == "hr":
                    text_at.pop(id(node), None)
            continue
        if tag in RAW:
            if tag == "textarea":
                node.controls += 1
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at).end()
            continue
        if closed and tag not in BLOCK:
            continue
        hide = hidden or tag in HIDDEN
        if tag in BLOCK and not hide:
            opened.push(tag, open_block(tag, tokens, truth), hide, link)
        else:
            opened.push(tag, node, hide, link or tag == "a")
    return root


def annotate(root: Node) -> list[Node]:
    """The nodes in page order, with sums over their subtrees."""
    nodes: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        node.order = len(nodes)
        nodes.append(node)
        todo.extend(reversed(node.children))
        kinds = Counter(c.tag for c in node.children)
        for k, c in enumerate(node.children):
            c.place, c.alike = k, kinds[c.tag]
    for node in reversed(nodes):
        own = "".join(node.runs)
        node.length, node.link_length, node.stops = len(own.strip()), node.link, own.count(".") + own.count(",") + own.count("!") + own.count("?")
        node.paragraphs, node.items = int(node.tag == "p"), int(node.tag == "li")
        for c in node.children:
            node.length += c.length
            node.link_length += c.link_length
            node.stops += c.stops
            node.paragraphs += c.paragraphs
            node.items += c.items
            node.controls += c.controls
    return nodes


def features(nodes: list[Node]) -> Iterator[list[float]]:
    """One row for each node: kind, attribute tokens, subtree density, depth and sibling statistics."""
    total = max(1, nodes[0].length) if nodes else 1
    context: list[tuple[int, int, int, int]] = []  # article, boilerplate tag, content tokens, boilerplate tokens above
    width = len(TAG_GROUPS)
    log = math.log1p
    for node in nodes:
        row = [0.0] * N_FEATURES
        group = _GROUP_OF.get(node.tag)
        if group is not None:
            row[group] = 1.0
        for k in node.tokens:
            row[width + k] = 1.0
        parent = node.parent
        up = (0, 0, 0, 0)
        if parent is not None:
            a, b, c, d = context[parent.order]
            up = (
                a or int(parent.tag in ("article", "main")),
                b or int(parent.tag in _BOILER_TAGS),
                c or int(bool(parent.tokens & {0, 1})),
                d or int(bool(parent.tokens & _BOILER_TOKENS)),
            )
        context.append(up)
        n = len(parent.children) if parent else 1
        length, links = node.length, min(node.link_length, node.length)
        i = width + len(TOKEN_GROUPS)
        row[i : i + 22] = [
            *map(float, up),
            log(length),
            links / length if length else 0.0,
            length / total,
            length / max(1, parent.length if parent else total),
            log(node.stops),
            node.stops / (1 + length),
            float(min(node.depth, 20)),
            log(len(node.children)),
            log(n),
            node.place / n,
            float(node.place == 0),
            node.alike / n,
            log(node.paragraphs),
            log(node.items),
            log(node.controls),
            length / (1 + len(node.children)),
            log(parent.paragraphs if parent else node.paragraphs),
            float(length == 0),
        ]
        yield row
