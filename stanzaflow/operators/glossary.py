"""Glossaries: entries with several forms, and where they stand in the lines of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import table_of
from .lexicon import leftmost_spans


@dataclass(frozen=True)
class Entry:
    term_id: str
    forms: tuple[str, ...]
    definition: str
    in_context: str = ""
    category: str = ""
    source_note: str = ""
    status: str = "published"


def checked(entries: list[Entry]) -> list[Entry]:
    """The published entries; ids must be unique, forms at least two characters long and of one entry only, published or not."""
    ids = [e.term_id for e in entries]
    forms = [f.strip() for e in entries for f in e.forms]
    if len(set(ids)) != len(ids) or not all(ids):
        raise ValueError("term ids must be there and unique")
    if any(len(f) < 2 for f in forms) or len(set(forms)) != len(forms) or any(not e.forms for e in entries):
        raise ValueError("each form must have two characters at least and stand once")
    if any(not e.definition.strip() or not e.status.strip() for e in entries):
        raise ValueError("an entry lacks its definition or status")
    return [e for e in entries if e.status == "published"]


def gloss_lines(lines: DataFrame, entries: list[Entry], id_col: str = "doc_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """``id, line_no, term_id, term, form, start_offset, end_offset, definition, category`` of every glossed span.

    Lines are read from left to right, at each place the longest form, then on behind it; a span never crosses a line.  Offsets count from the
    line's start; with ``start_offset`` among the columns of ``lines`` (see ``segment.split_lines``) ``doc_offset`` tells the place in the document.  Spans come
    out of the line's own row, so lines and spans aren't joined.
    """
    published = checked(entries)
    kind = "array<struct<term_id:string,term:string,definition:string,category:string>>"
    listed = [{"term_id": e.term_id, "term": e.forms[0].strip(), "definition": e.definition, "category": e.category} for e in published]
    of_form = {f.strip(): i for i, e in enumerate(published) for f in e.forms}
    key = [id_col, line_no, *(["start_offset"] if "start_offset" in lines.columns else [])]
    columns = ["term_id", "term", "definition", "category"]
    if not published:
        return lines.limit(0).select(id_col, line_no, *[F.lit("").alias(c) for c in columns])
    rows = lines.select(F.struct(*key).alias("_line"), F.col(text).alias("_text"))
    spans = leftmost_spans(rows, list(of_form), "_line", "_text")
    entry = F.get(table_of(listed, kind), F.element_at(table_of(of_form, "map<string,int>"), F.col("word")))
    told = spans.withColumn("_e", entry)
    place = [(F.col("_line.start_offset") + F.col("start_offset")).alias("doc_offset")] if "start_offset" in key else []
    return told.select(f"_line.{id_col}", f"_line.{line_no}", F.col("word").alias("form"), "start_offset", "end_offset", *place, *[F.col(f"_e.{c}").alias(c) for c in columns])
