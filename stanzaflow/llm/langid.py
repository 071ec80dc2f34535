"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 letters, words set off by
blanks), most frequent first.  A document has a profile of the same kind, made of its whole text; its
distance to a language is the sum over its n-grams of how far out of place each is in the
language's list, where an n-gram that isn't there counts the list's full length.  The nearest
language is predicted; the score is 1 - distance / largest possible distance.

Profiles are learned from at most ``SAMPLE_DOCS`` documents of each language (a documented bound;
those with the smallest hash of their id).  Prediction reads the text alone.

Defined cases: null texts and texts without letters are ``und`` with score 0; without any labelled
text all are ``und``, and a language without n-grams is never predicted; ties go to the language first in order of name; n-grams with equal counts are
ordered by their code points; the length of a text isn't limited; repeated rows are predicted each, and rows that share a
doc_id are learned from or held out together; a row without a doc_id isn't held out; an empty table gives an empty
result; extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, first_by_hash

PROFILE = 300  # n-grams in a profile
SAMPLE_DOCS = 1000  # labelled documents that a language's profile is learned from, at most
BROADCAST_IDS = 200_000  # sampled ids up to which they are broadcast to filter the documents
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a character) in rising order, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    is_letter = _letter_table()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(is_letter, codes, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])
    c = c[(c != 32) | (np.concatenate([[0], c[:-1]]) != 32)]  # one blank between words
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code points."""
    return grams[np.lexsort((grams, -counts))[:size]]


def held_out(doc_id="doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn_profiles(labelled: DataFrame, size: int = PROFILE, sample: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Profiles by language from ``labelled(doc_id, text, lang)``.

    Tasks count the n-grams of the sampled documents and add them up before the shuffle; only the
    finished profiles (``size`` n-grams a language) come to the driver.
    """
    known = labelled.filter("text is not null and lang is not null").select("doc_id", "lang")
    chosen = cut(first_by_hash(known, "lang", sample))
    if chosen.count() <= BROADCAST_IDS:  # so the texts aren't shuffled for the sake of a few
        chosen = F.broadcast(chosen)
    texts = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, n = ngrams(text)
                if lang in total:
                    both = np.concatenate([total[lang][0], g])
                    g, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([total[lang][1], n]), len(g)).astype(np.int64)
                total[lang] = (g, n)
        for lang, (g, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    grams = texts.select("lang", "text").mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = grams.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").collect()
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64) for lang, g in profiles.items()}


class Profiles:
    """Ranks of all profiles in one table, to compare a document with all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.langs = size, sorted(lang for lang, p in profiles.items() if len(p))
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.place = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.place[k, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(*ngrams(text), self.size)
        if not len(own) or not len(self.grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.where(self.grams[at] == own, self.place[:, at], -1)
        off = np.where(place >= 0, np.minimum(np.abs(place - np.arange(len(own))), self.size), self.size).sum(axis=1)
        best = int(np.argmin(off))
        return self.langs[best], 1.0 - float(off[best]) / (self.size * len(own))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text)``; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(shared.value, size)
        for batch in batches:
            found = [table.predict(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predicted, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that aren't held out, and predict all."""
    return predict_language(docs, learn_profiles(docs.filter(~held_out())))
