"""HTML as rows where order and nesting matter: year rows between sibling blocks, and lists of works.

Patterns can't follow nesting, so a Python function walks each page once, in its row or its Arrow batch: pages aren't
shuffled, and a page that isn't well-formed is read as browsers do in the main (void elements, a paragraph ended by the next block).
What can be told from the rows afterwards (years, cleaned texts, digests) is worked out by built-in functions.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

# fixed values: marks of the pages these walks were made for
BLOCK, LABEL, ANCHOR, BEGIN, END = "div.detail", "div.label1", "ViewDetail", "beginYear", "endYear"
ITEM, LINK = "div.poemTitle.showDetail", "Query.aspx"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@lru_cache
def _parts_of(selector: str) -> tuple[str, frozenset[str]]:
    name, *classes = selector.split(".")
    return name, frozenset(classes)


class Node:
    """An element with its children in order; texts are children too."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent

    def fits(self, selector: str) -> bool:
        """``name``, ``name.class`` or ``name.class.class``."""
        name, classes = _parts_of(selector)
        return self.name == name and classes <= set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.name not in ("script", "style"):
                stack.extend(reversed(node.children))
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P and self.here.name == "p":
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


_S = r"[ \t\n\r\f]"
#: Tags with quoted attributes in small letters, whole comments and texts: what the parser reads in one way only.
_PLAIN = re.compile(rf"""<([a-z][a-z0-9]*)((?:{_S}+[a-z][-a-z0-9]*=(?:'[^'<>]*'|"[^"<>]*"))*){_S}*>|</([a-z][a-z0-9]*)>|<!--(?:[^->]|-(?!-))*-->|([^<]+)""")
_ATTR = re.compile(rf"""{_S}+([a-z][-a-z0-9]*)=(?:'([^']*)'|"([^"]*)")""")
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())  # their content is read in another way
_attr_text = getattr(html.parser, "_unescape_attrvalue", unescape)


@lru_cache(4096)
def _attrs(text: str) -> dict[str, str]:
    """Attributes of a plain tag; pages repeat them, and nothing changes them."""
    return {k: _attr_text(v) if "&" in v else v for k, a, b in _ATTR.findall(text) for v in (a or b,)}


def _plain_tree(page: str) -> Node | None:
    """The parser's tree of a page of nothing but plain markup, in a fraction of its time; else nothing."""
    root = here = Node("", {}, None)
    at = 0
    for m in _PLAIN.finditer(page):
        if m.start() != at:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 4:
            text = m[4]
            if "&" in text:  # the commonest reference alone needs no search
                text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else unescape(text)
            here.children.append(text)
        elif kind == 2:
            name, attrs = m.group(1, 2)
            if name in _RAW:
                return None
            if name in _ENDS_P and here.name == "p":
                here = here.parent
            node = Node(name, _attrs(attrs) if attrs else {}, here)
            here.children.append(node)
            if name not in _VOID:
                here = node
        elif kind == 3:
            name, node = m[3], here
            while node is not root and node.name != name:
                node = node.parent
            if node is not root:
                here = node.parent
    return root if at == len(page) else None


def tree_of(page: str | None) -> Node:
    plain = _plain_tree(page or "")
    if plain is not None:
        return plain
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree.root


@lru_cache
def _bound(name: str) -> re.Pattern:
    return re.compile(rf"[?&]{re.escape(name)}=(-?\d{{1,9}})(?:&|#|$)")


@lru_cache(4096)
def _bounds(href: str, begin: str, end: str) -> tuple[int | None, int | None]:
    found = (_bound(k).search(href) for k in (begin, end))
    low, high = (int(m.group(1)) if m else None for m in found)
    return low, high


def year_rows_of(html: str | None, block: str, label: str, anchor: str, begin: str, end: str, left_out: str) -> Iterator[tuple]:
    """``block_no, label_id, row_index, begin, end, text`` of a page; see ``year_rows``."""
    index = 0
    nodes = list(tree_of(html).walk())
    for number, node in enumerate([n for n in nodes if n.fits(block)]):
        siblings = [c for c in node.parent.children if isinstance(c, Node)]
        place = next(i for i, c in enumerate(siblings) if c is node)
        before = siblings[place - 1] if place else None
        if before is None or not before.fits(label):
            continue
        link = next((n for n in before.walk() if n.name == "a" and anchor in n.attrs.get("href", "")), None)
        years = _bounds(link.attrs["href"], begin, end) if link is not None else (None, None)
        if None in years:
            continue
        held: list[str] = []
        for child in [*node.children, None]:
            href = child.attrs.get("href", "") if isinstance(child, Node) and child.name == "a" else ""
            border = child is None or (anchor in href and begin in href)
            if not border:
                if isinstance(child, str):
                    held.append(child)
                elif not (left_out and child.fits(left_out)):
                    held.append(child.text())
                continue
            text = " ".join("".join(held).split())
            if text and None not in years:
                yield number, node.attrs.get("id", ""), index, *years, text
                index += 1
            held = []
            if child is not None:
                years = _bounds(href, begin, end)
    for node in nodes:  # without links upwards the tree isn't left to the garbage collector
        node.parent = None


def year_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", block: str = BLOCK, label: str = LABEL, anchor: str = ANCHOR, begin: str = BEGIN, end: str = END, left_out: str = "") -> DataFrame:
    """``id, block_no, label_id, row_index, begin, end, text, event_hash``: year rows of the blocks of each page.

    A fold over siblings: a block counts only if the element right before it is its label, and the label's link gives both years.  The
    block's own children are read in order: a link with years ends the row before it and gives the years of the next one; if
    it lacks a year, what follows is left out up to the next link.  Rows without text aren't kept.  ``left_out`` names elements
    whose texts don't count.  The hash is that of the row's whole text.
    """

    names = ["block_no", "label_id", "row_index", "begin", "end", "text"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *row) for n, html in enumerate(batch.column(1)) for row in year_rows_of(html.as_py(), block, label, anchor, begin, end, left_out)]
            at, *columns = zip(*rows) if rows else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *map(pa.array, columns, kinds)], [id_col, *names])

    given = pages.select(F.col(id_col), F.col(html_col).alias("_html"))
    kind = S.StructType([given.schema[0], *[S.StructField(n, S.StringType() if k == pa.string() else S.IntegerType()) for n, k in zip(names, kinds)]])
    return given.mapInArrow(walked, kind).withColumn("event_hash", F.sha2("text", 256))


def entries_of(html: str | None, item: str, link: str, author: str, time: str) -> Iterator[tuple]:
    """``entry_no, parent_no, depth, href, title, author, time, raw`` of a page; see ``list_entries``."""
    seen: dict[int, int] = {}
    depth: dict[int, int] = {}
    number = 0
    for node in tree_of(html).walk():
        if not node.fits(item):
            continue
        above = node.parent
        while above is not None and id(above) not in seen:
            above = above.parent

        def own(n: Node) -> Iterator[Node]:  # without the items inside this one
            for c in n.children:
                if isinstance(c, Node) and not c.fits(item):
                    yield c
                    yield from own(c)

        inside = list(own(node))
        a = next((n for n in inside if n.name == "a" and link in n.attrs.get("href", "")), None)
        title = a.text() if a is not None else ""
        if not title:
            continue
        seen[id(node)], depth[id(node)] = number, 0 if above is None else depth[id(above)] + 1
        texts = [next((n.text() for n in inside if n.fits(s)), None) if s else None for s in (author, time)]
        raw = " ".join(" ".join(c if isinstance(c, str) else c.text() for c in node.children if isinstance(c, str) or not any(x.fits(item) for x in c.walk())).split())
        yield number, None if above is None else seen[id(above)], depth[id(node)], a.attrs["href"], title, *texts, raw
        number += 1


def list_entries(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", item: str = ITEM, link: str = LINK, author: str = "span.author", time: str = "span.time") -> DataFrame:
    """``id, entry_no, parent_no, depth, href, title, author, time, raw`` of the items of a page's lists.

    Items may be nested: each has its own link, author and time, not those of the items inside it, and names the item around it.
    An item without a link that has a title is no entry, nor a parent.
    """

    @F.udtf(returnType="entry_no int, parent_no int, depth int, href string, title string, author string, time string, raw string")
    class Entries:
        def eval(self, html: str):
            yield from entries_of(html, item, link, author, time)

    return pages.select(F.col(id_col), F.col(html_col).alias("_html")).lateralJoin(Entries(F.col("_html").outer())).drop("_html")


def work_years(entries: DataFrame, own_author: Column | None = None) -> DataFrame:
    """``list_entries`` with ``years`` and ``precision``, from the time of an entry or else the brackets in its text.

    One year is ``exact``, several are a ``range``, none is ``unknown``.  An author that is a year is none; with ``own_author`` entries of
    another author go, and those without one stay.
    """
    told = F.coalesce("time", F.array_join(F.regexp_extract_all("raw", F.lit(r"[(（]([^()（）]*)[)）]"), F.lit(1)), " "))
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(told, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))))
    author = F.when(F.col("author").rlike(r"\d{3,4}"), None).otherwise(F.nullif(F.trim("author"), F.lit("")))
    out = entries.withColumn("author", author).withColumn("years", F.coalesce(years, F.array().cast("array<int>")))
    out = out.withColumn("precision", F.when(F.size("years") == 0, "unknown").when(F.size("years") == 1, "exact").otherwise("range"))
    return out if own_author is None else out.filter(F.col("author").isNull() | (F.col("author") == own_author))
