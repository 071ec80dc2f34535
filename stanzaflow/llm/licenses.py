"""License scan by an exact set-similarity join of text blocks with license templates.

A template is a set of words and a containment threshold; a block is a stretch of a document's words, ``2 * step`` long, one
beginning every ``step`` words, so a stretch as long as the longest template lies whole in some block.  A block matches a template if it
holds at least ``percent`` of the template's distinct words.  The templates' words are put in one global order, the rarest in all
documents first (one pass counts them).  Three filters follow from that order, and none loses a match:

* prefix: of a template of size t that needs s words, a matching block holds one of the t - s + 1 rarest words;
* length: a block with fewer than s words of any template can't match;
* position: after the first common word, the words left in block and template must still make s.

What passes is verified on the whole sets.  Phrases are templates too, with a threshold of 100 per cent; an exact check then finds
the places where their words stand one behind another.  A phrase's place belongs to the one block in whose first half it begins.

The templates are a parameter, ``MAX_WORDS`` words at most together, and go to the tasks with the code; documents are joined where they
are read, so no text is shuffled and a lost executor costs its own partitions only.

Defined cases: a null or empty text has no words and no matches; a phrase cut by other words, or one whose words stand in
another order, is no place; overlapping places count each; ties in the order of words are settled by the words themselves; rows
that share a doc_id give a row each; a text's length isn't limited; an empty table gives an empty result; other columns of
the input aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 64
MAX_WORDS = 100_000

_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    percent: int = 80  # of the distinct words, that a block must hold
    phrase: bool = False  # only places where the words stand one behind another count


#: The phrases of the contract.
PHRASES = [
    Template("mit", "mit license", 100, True),
    Template("apache", "apache license", 100, True),
    Template("gpl", "general public license", 100, True),
]

#: Openings of license notices as their licensors publish them.
NOTICES = [
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", 90),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution international license", 90),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 100),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 100),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "licensed under the gnu lesser general public license", 100),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased ASCII letters and non-ASCII characters."""
    return text.encode("utf-8").translate(_TO_WORDS).split() if text else []


class Joiner:
    """The templates' side of the join: words in global order, prefixes indexed by word."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], step: int = STEP):
        words = [words_of(t.text) for t in templates]
        self.templates, self.step = templates, max(step, *map(len, words))
        self.place = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}, key=lambda w: (counts.get(w, 0), w)))}
        self.sequences = [np.array([self.place[w] for w in ws], np.int32) for ws in words]
        self.sets = [np.unique(s) for s in self.sequences]
        self.needed = [-(-t.percent * len(s) // 100) for t, s in zip(templates, self.sets)]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (own, needed) in enumerate(zip(self.sets, self.needed)):
            for j, w in enumerate(own[: len(own) - needed + 1].tolist()):
                self.index.setdefault(w, []).append((t, j))
        self.in_prefix = np.zeros(len(self.place) + 1, bool)  # the last entry stands for words of no template
        self.in_prefix[list(self.index)] = True

    def candidates(self, block: np.ndarray) -> list[int]:
        """Templates that pass the filters for a block's set of places in the global order."""
        passed, met, size = [], set(), len(block)
        for i, w in enumerate(block.tolist()):
            for t, j in self.index.get(w, ()):
                if t in met:
                    continue
                met.add(t)
                if 1 + min(size - i - 1, len(self.sets[t]) - j - 1) >= self.needed[t]:
                    passed.append(t)
        return passed

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int, list[int]]]:
        """``(template, first word, words of the block, common words, places)`` of every block that matches."""
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        met = np.flatnonzero(self.in_prefix[ids])
        if not len(met):
            return []
        cores = np.unique(met // self.step)
        found = []
        for k in np.union1d(cores, np.maximum(cores - 1, 0)).tolist():
            start = k * self.step
            own = ids[start : start + 2 * self.step]
            block = np.unique(own[own >= 0])
            for t in self.candidates(block):
                common = len(np.intersect1d(block, self.sets[t], assume_unique=True))
                if common < self.needed[t]:
                    continue
                places: list[int] = []
                if self.templates[t].phrase:
                    places = self._places(own, t, start)
                    if not places:
                        continue
                found.append((t, start, len(own), common, places))
        return found

    def _places(self, own: np.ndarray, t: int, start: int) -> list[int]:
        sequence = self.sequences[t]
        n = min(self.step, len(own) - len(sequence) + 1)
        if n <= 0:
            return []
        here = np.ones(n, bool)
        for m, w in enumerate(sequence):
            here &= own[m : m + n] == w
        return (start + np.flatnonzero(here)).tolist()


def word_counts(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of the templates' words stands in all texts; a row for each word comes to the driver."""
    place = {w: k for k, w in enumerate(words)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = words_of(cell.as_py())
                ids = np.fromiter(map(place.get, own, repeat(len(words))), np.int64, len(own))
                total += np.bincount(ids, minlength=len(total))
        k = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], ["word", "n"])

    sums = docs.select("text").mapInArrow(counted, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r["word"]]: r["n"] for r in sums.collect()}


_MATCH = pa.struct([("template", pa.int32()), ("first", pa.int64()), ("length", pa.int64()), ("common", pa.int64()), ("places", pa.list_(pa.int64()))])


def scan(docs: DataFrame, templates: list[Template] | None = None, step: int = STEP) -> DataFrame:
    """``doc_id, n_words, matches`` for each row of ``docs(doc_id, text)``.

    ``matches`` is an array of ``label, phrase, first, length`` (the block, in words) ``, common, containment, places``, one for
    each block and template that meet the template's threshold; ``places`` are the first words of a phrase's occurrences.
    """
    templates = [*PHRASES, *NOTICES] if templates is None else list(templates)
    if any(not words_of(t.text) or not 0 < t.percent <= 100 for t in templates) or sum(len(words_of(t.text)) for t in templates) > MAX_WORDS:
        raise ValueError(f"templates need words, percentages above 0, and no more than {MAX_WORDS} words together")
    counts = word_counts(docs, sorted({w for t in templates for w in words_of(t.text)}))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, matches array<struct<template:int,first:bigint,length:bigint,common:bigint,places:array<bigint>>>"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(templates, counts, step)
        for batch in batches:
            sizes, found = [], []
            for cell in batch.column(1):
                words = words_of(cell.as_py())
                sizes.append(len(words))
                found.append([dict(zip(("template", "first", "length", "common", "places"), m)) for m in joiner.matches(words)])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "matches"])

    told = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(len(set(words_of(t.text)))).alias("size")) for t in templates])

    def named(m):
        t = F.element_at(told, m["template"] + 1)
        return F.struct(t["label"].alias("label"), t["phrase"].alias("phrase"), m["first"].alias("first"), m["length"].alias("length"), m["common"].alias("common"), (m["common"] / t["size"]).alias("containment"), m["places"].alias("places"))

    found = docs.select("doc_id", "text").mapInArrow(joined, schema)
    return found.select("doc_id", "n_words", F.transform("matches", named).alias("matches"))


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, labels and the greatest containment of what ``scan`` gives; no matches score 0."""
    base = F.filter("matches", lambda m: m["phrase"])
    places = F.flatten(F.transform(base, lambda m: m["places"]))

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )
