"""Cutting documents into lines, clauses and windows, with exact offsets.

A document is cut within its row and exploded at the end, so texts aren't shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import running_sums
from ..functions.text import LATIN_SENTENCE_END, content_hash, text_of


#: Unicode's white space, a fixed value.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = LATIN_SENTENCE_END) -> DataFrame:
    """``id, line_no, stanza_no, text, start_offset, end_offset, line_hash`` of each non-blank line.

    A line ends after a sentence end or before a line end (``\\r\\n`` is one).  Offsets are 0-based and half
    open, in characters.  Two blank segments or more between lines start a new stanza.
    The pieces, blank ones included, come from one regular expression; their running lengths are the
    offsets, so nothing is looked up again in the text.  Null and empty texts have no line.
    """
    pattern = f"([^{ends}\r\n]*[{ends}]|[^{ends}\r\n]*(?:\r\n|\r|\n)|[^{ends}\r\n]+)"
    cut = docs.select(F.col(id_col), F.regexp_extract_all(text_of(text_col), F.lit(pattern), F.lit(1)).alias("_raw"))
    placed = cut.withColumn("_at", running_sums(F.transform("_raw", lambda x: F.length(x))))
    blank = F.lit(WHITE_SPACE)
    pieces = F.zip_with("_raw", "_at", lambda x, at: F.struct(F.btrim(x, blank).alias("line"), (at + F.length(x) - F.length(F.ltrim(x, blank))).alias("start")))
    placed = placed.select(id_col, pieces.alias("_p"))
    placed = placed.select(id_col, "_p", running_sums(F.transform("_p", lambda p: (p["line"] == "").cast("int"))).alias("_blanks"))
    kept = F.filter(F.arrays_zip("_p", "_blanks"), lambda p: p["_p"]["line"] != "")
    lines = placed.select(id_col, kept.alias("_l"))
    new = F.transform("_l", lambda x, i: F.when((i > 0) & (x["_blanks"] - F.get("_l", i - 1)["_blanks"] >= 2), 1).otherwise(0))
    lines = lines.select(id_col, "_l", new.alias("_new")).select(id_col, "_l", "_new", running_sums("_new").alias("_stanza"))
    rows = lines.select(id_col, F.posexplode(F.arrays_zip("_l", "_new", "_stanza")).alias("_n", "x"))
    line, start = F.col("x._l._p.line"), F.col("x._l._p.start")
    return rows.select(
        F.col(id_col),
        (F.col("_n") + 1).alias("line_no"),
        (F.col("x._stanza") + F.col("x._new") + 1).alias("stanza_no"),
        line.alias("text"),
        start.alias("start_offset"),
        (start + F.length(line)).alias("end_offset"),
        content_hash(line).alias("line_hash"),
    )


def _clauses(text_col: str, ends: str) -> Column:
    return F.filter(F.transform(F.split(text_of(text_col), f"(?<=[{ends}])\n?|\n"), lambda c: F.trim(c)), lambda c: c != "")


def split_clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = LATIN_SENTENCE_END) -> DataFrame:
    """``id, clause_no, clause``: non-blank clauses that keep their end mark, numbered from 1."""
    return docs.select(F.col(id_col), F.posexplode(_clauses(text_col, ends)).alias("_n", "clause")).select(id_col, (F.col("_n") + 1).alias("clause_no"), "clause")


def clauses_in_context(docs: DataFrame, word: str, id_col: str = "doc_id", text_col: str = "text", ends: str = LATIN_SENTENCE_END, reach: int = 1) -> DataFrame:
    """``id, clause_no, context``: the clauses that hold a word, each with its neighbours up to ``reach`` on both sides."""
    cut = docs.select(F.col(id_col), _clauses(text_col, ends).alias("_c")).filter(F.exists("_c", lambda c: F.contains(c, F.lit(word))))
    first = lambda i: F.greatest(i - reach, F.lit(0))
    near = F.transform("_c", lambda c, i: F.struct(c.alias("clause"), (i + 1).alias("clause_no"), F.array_join(F.slice("_c", first(i) + 1, i + reach + 1 - first(i)), "").alias("context")))
    hits = cut.select(id_col, F.explode(F.filter(near, lambda x: F.contains(x["clause"], F.lit(word)))).alias("x"))
    return hits.select(id_col, "x.clause_no", "x.context")


def clean_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delimiters: str = ",.!?;:\n", low: int = 5, high: int = 16, letters: str = r"\p{L} ") -> DataFrame:
    """Phrases between delimiters of ``low`` to ``high`` characters that hold nothing but letters."""
    parts = F.transform(F.split(text_of(text_col), f"[{delimiters}]"), lambda p: F.trim(p))
    fit = F.filter(parts, lambda p: F.length(p).between(low, high) & p.rlike(f"^[{letters}]+$"))
    return docs.select(F.col(id_col), F.posexplode(fit).alias("phrase_no", "phrase"))


def neighbour_context(clauses: DataFrame, id_col: str, order_col: str, text_col: str, reach: int = 1) -> DataFrame:
    """Adds ``context`` to a table of clauses: each with its neighbours up to ``reach`` on both sides."""
    around = W.partitionBy(id_col).orderBy(order_col).rowsBetween(-reach, reach)
    return clauses.withColumn("context", F.array_join(F.collect_list(text_col).over(around), ""))


# fixed values
CHUNK_LIMIT = 7000
CHUNK_MARKS = "\n。！？；"


def chunk_borders(text: str, limit: int, marks: str) -> list[int]:
    """Where a text is cut so that no piece is longer than ``limit``: behind the last mark in a piece's last fifth, if there is one."""
    stops = [m.end() for m in re.finditer(f"[{re.escape(marks)}]", text)]
    borders = [0]
    while len(text) - borders[-1] > limit:
        furthest = borders[-1] + limit
        before = bisect_right(stops, furthest)
        stop = stops[before - 1] if before else 0
        borders.append(stop if stop > furthest - limit + limit * 4 // 5 else furthest)
    return [*borders, len(text)]


def chunk_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_LIMIT, marks: str = CHUNK_MARKS) -> DataFrame:
    """``id, chunk_no, chunk``: the trimmed pieces between ``chunk_borders``; blank pieces and null texts give none.

    Where a piece ends depends on the piece before it, so the borders are found in Python, texts coming in Arrow batches.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(t or "").strip() for t in pdf[text_col]]
            cuts = [chunk_borders(t, limit, marks) for t in texts]
            pieces = [[p for p in (t[a:b].strip() for a, b in zip(c, c[1:])) if p] for t, c in zip(texts, cuts)]
            whole = pd.DataFrame({id_col: pdf[id_col], "chunk": pieces}).explode("chunk").dropna(subset="chunk")
            yield whole.assign(chunk_no=whole.groupby(level=0).cumcount().astype("int32"))[[id_col, "chunk_no", "chunk"]]

    return docs.select(id_col, text_col).mapInPandas(chunked, f"{id_col} {kind}, chunk_no int, chunk string")


# fixed values: lengths of clauses that are shown, and of those that fill up
STRICT, RELAXED = (3, 44), (2, 60)


def display_picks(clauses: DataFrame, aliases: list[str], imagery: list[str], id_col: str = "doc_id", no_col: str = "clause_no", text_col: str = "clause", owner: str | None = None, k: int = 3, least: int = 2, strict: tuple[int, int] = STRICT, relaxed: tuple[int, int] = RELAXED) -> DataFrame:
    """``id, clause_no, clause, score, place``: the clauses of each document that are worth showing, ``k`` at most.

    A clause scores 3 if an alias is one of its windows of three characters, or of the shorter ones at its end, 2 for each alias and 1 for each word of
    ``imagery`` it holds; of equal ones the later counts.  Clauses are of a ``strict`` length and don't name the ``owner`` (a column).  A
    document with fewer than ``least`` is filled up with its first clauses of the ``relaxed`` length whose text isn't picked yet; these have
    no score.
    """
    text, n = F.col(text_col), F.length(text_col)
    names = sorted(set(aliases))
    window = F.lit(False)
    for a in names:
        window |= F.contains(text, F.lit(a)) if len(a) == 3 else F.endswith(text, F.lit(a)) if len(a) < 3 else F.lit(False)
    met = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in sorted(set(words))), F.lit(0))
    rows = clauses if owner is None else clauses.filter((F.coalesce(owner, F.lit("")) == "") | ~F.contains(text, F.col(owner)))
    rows = rows.select(F.col(id_col), F.col(no_col), text)
    scored = rows.filter(n.between(*strict)).withColumn("score", F.when(window, 3).otherwise(0) + 2 * met(names) + met(imagery))
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("score"), F.desc(no_col)))
    first = scored.withColumn("place", place).filter(F.col("place") <= k)
    have = first.groupBy(id_col).agg(F.count("*").alias("_have"), F.collect_set(text_col).alias("_texts"))  # k texts at most
    short = rows.filter(n.between(*relaxed)).groupBy(id_col, text_col).agg(F.min(no_col).alias(no_col)).join(have, id_col, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = short.filter((F.col("_have") < least) & ~F.coalesce(F.array_contains("_texts", text), F.lit(False)))
    more = short.withColumn("place", F.col("_have") + F.row_number().over(W.partitionBy(id_col).orderBy(no_col))).filter(F.col("place") <= least)
    return first.unionByName(more.select(id_col, no_col, text_col, F.lit(None).cast("int").alias("score"), F.col("place").cast("int").alias("place")))
