"""Main text of HTML pages by gradient-boosted trees over DOM nodes, decoded on the tree.

Each block element (and each run of text beside block elements) gets numbers: its kind, attribute tokens,
text and link density of its subtree, depth, sibling statistics, and what stands above it.  Boosted trees
give each node the log odds of holding main text.  Decoding picks the set of nodes with the largest
sum of log odds in which no node is kept without its parent: computed bottom-up, each subtree is kept
only if it is worth it, so no descendant of a rejected element is kept and none is decided twice.

The trees are trained on generated pages whose main text is known (``html_pages``), ``TRAIN_PAGES`` of
them; training doesn't depend on the table.

Text of a kept leaf: character references decoded, white space turned into single spaces, trimmed; blocks
are joined by a line end in page order.

Defined cases: null and empty pages give an empty text; pages without markup are one block of text; broken
and unclosed markup is read as browsers do in the usual cases, in time linear in the page; attributes may be
malformed or repeated, a quote that is never closed is an ordinary character, and a tag that is open at the end
of the page is dropped; scripts, styles, forms' controls, comments of the markup and head elements never give text; equal
pages and repeated rows give equal texts; ids may be null; pages of any length are read whole; a subtree whose odds sum up to exactly
0 is left out; an empty table gives an empty result; extra columns, whatever their names, aren't read, so none can clash with an output.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost, dom
from .html_pages import generated_pages

TRAIN_PAGES = 1200
PAGES_AT_ONCE = 64
CHARS_AT_ONCE = 2_000_000
NODES_AT_ONCE = 8192
LIMIT = 8.0  # bound of a node's log odds, so that one node can't outweigh a whole branch

_trained: list[boost.BoostedTrees] = []


def wanted_nodes(nodes: list[dom.Node]) -> list[int]:
    """For each node of a generated page: does its subtree hold wanted text?"""
    truth = [0] * len(nodes)
    for n in nodes:
        truth[n.order] = n.truth if n.truth is not None else truth[n.parent.order] if n.parent else 0
    for n in reversed(nodes):
        own = bool(n.runs) and n.length > 0
        truth[n.order] = int((truth[n.order] and (own or not n.children)) or any(truth[c.order] for c in n.children))
    return truth


def labelled_nodes(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of all nodes of generated pages."""
    rows, wanted = [], []
    for html in pages:
        nodes = dom.annotate(dom.parse(html))
        rows += dom.features(nodes)
        wanted += wanted_nodes(nodes)
    return np.array(rows), np.array(wanted, float)


def model() -> boost.BoostedTrees:
    """The trained trees; fitted once in a process."""
    if not _trained:
        _trained.append(boost.fit(*labelled_nodes(generated_pages(TRAIN_PAGES))))
    return _trained[0]


def kept_blocks(nodes: list[dom.Node], odds: np.ndarray) -> list[str]:
    """Texts of the leaves in the best set of nodes closed under parents."""
    worth = np.clip(odds, -LIMIT, LIMIT).tolist()
    for n in reversed(nodes):  # children come after parents in the list
        if n.parent is not None and worth[n.order] > 0:
            worth[n.parent.order] += worth[n.order]
    keep = [False] * len(nodes)
    out = []
    for n in nodes:
        keep[n.order] = worth[n.order] > 0 and (n.parent is None or keep[n.parent.order])
        if keep[n.order] and n.runs:
            text = n.text()
            if text:
                out.append(text)
    return out


def node_odds(pages: list[list[dom.Node]], trees: boost.BoostedTrees) -> np.ndarray:
    """Log odds of the nodes of all pages, one page after the other; features are held for ``NODES_AT_ONCE`` nodes at a time."""
    out, flat = [], array("d")

    def flush() -> None:
        out.append(trees.log_odds(np.frombuffer(flat.tobytes()).reshape(-1, dom.N_FEATURES)))
        del flat[:]

    for nodes in pages:
        for row in dom.features(nodes):
            flat.extend(row)
            if len(flat) >= NODES_AT_ONCE * dom.N_FEATURES:
                flush()
    flush()
    return np.concatenate(out)


def main_texts(pages: list[str | None], trees: boost.BoostedTrees) -> list[str]:
    """The main text of each page."""
    parsed = [dom.annotate(dom.parse(html)) if html else [] for html in pages]
    odds = node_odds(parsed, trees)
    out, at = [], 0
    for nodes in parsed:
        out.append("\n".join(kept_blocks(nodes, odds[at : at + len(nodes)])) if nodes else "")
        at += len(nodes)
    return out


def _in_parts(cells: pa.Array) -> Iterator[list[str | None]]:
    """The pages of a batch, some at a time: up to ``PAGES_AT_ONCE``, fewer if they are long."""
    held, size = [], 0
    for cell in cells:
        held.append(cell.as_py())
        size += len(held[-1] or "")
        if len(held) == PAGES_AT_ONCE or size >= CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def extract_text(pages: DataFrame, trees: boost.BoostedTrees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``; one narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            at = 0
            for part in _in_parts(whole.column(2)):
                batch = whole.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main_texts(part, trees), pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(extracted, schema)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
