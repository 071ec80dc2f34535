"""Array expressions that Spark lacks: running sums, and places of a word in a text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values, kind: str, zero, op) -> Column:
    """For each entry of an array the entries before it put together by ``op``, which must be associative with ``zero`` as its neutral element.

    The array is put together in slices, and within each slice, so that long arrays aren't copied once for each entry.
    """
    values, zero = F.col(values) if isinstance(values, str) else values, F.lit(zero).cast(kind)

    def slices(v: Column) -> Column:
        width = F.least(F.lit(SLICE), F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v))).cast("int")))  # appending copies, so short arrays are cut finer
        starts = lambda w: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int"))
        cut = lambda w: F.transform(starts(w), lambda k: F.slice(v, k * w + 1, w))
        return F.when(F.size(v) > 0, let(width, cut)).otherwise(F.array().cast(f"array<array<{kind}>>"))

    def before(entries: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(entries, state, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda s: F.aggregate(s, zero, op))
        return F.flatten(F.zip_with(parts, before(totals, zero), before))

    return let(values.cast(f"array<{kind}>"), lambda v: let(slices(v), whole))


def running_sums(values) -> Column:
    """For each entry of an array of whole numbers the sum of the entries before it, as ``array<int>``."""
    return running(values, "int", 0, lambda a, x: a + x)


def literal(word: str) -> str:
    """A pattern that matches a word itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def table_of(rows, kind: str) -> Column:
    """A small lexicon as a constant of the plan: one literal, whatever its size."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def places_of(text, word, overlapping: bool = False, pattern: Column | None = None) -> Column:
    """0-based places of a literal word in a text, from left to right without overlap unless it is asked for, as ``array<int>``.

    The word may be a column if its ``literal`` pattern is given too.
    """
    text = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(literal(word)) if pattern is None else pattern
    word = F.lit(word) if isinstance(word, str) else word
    none = F.array().cast("array<int>")
    if overlapping:  # cut before each place: the pieces start there, but for the first
        starts = running_sums(F.transform(F.split(text, F.concat(F.lit("(?="), pattern, F.lit(")")), F.lit(-1)), lambda g: F.length(g)))
        places = F.filter(starts, lambda x, i: (i > 0) | F.startswith(text, word))
    else:  # the running lengths of gaps and hits are the ends of the hits
        ends = running_sums(F.transform(F.split(text, pattern, F.lit(-1)), lambda g: F.length(g) + F.length(word)))
        places = F.transform(F.filter(ends, lambda _, i: i > 0), lambda e: e - F.length(word))
    return F.when(F.contains(text, word), places).otherwise(none)
