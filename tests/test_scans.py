"""Scans of texts with many hits."""

import time

from pyspark.sql import functions as F

from stanzaflow.operators import affect, lexicon
from stanzaflow.plans import lexicons as L

PART = "with the ontion of tion und schaft not ing erst eau thereau "


def test_texts_with_many_hits(spark):
    """Thousands of hits in a text are taken in a time that grows with their number."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(PART * 1000).alias("text"), F.lit("the ing").alias("title"))
    start = time.time()
    hits = lexicon.interval_matches(docs, L.EMOTIONS, excluded=L.EXCLUDED, negators=L.NEGATORS).groupBy("label", "term").count().collect()
    spans = lexicon.matches_outside(docs, L.WORDS, {"tion": ("[aou]", r"s|\s")}).groupBy("word").count().collect()
    n_scores = affect.document_scores(docs, L.EMOTIONS, {}, "title", "text", "doc_id", L.EXCLUDED, L.NEGATORS).groupBy(F.size("scores")).count().collect()
    took = time.time() - start
    whole = 300_000
    want = {("calm", "with the"): whole, ("calm", "ther"): whole, ("grief", "ontion"): whole, ("joy", "eau"): 2 * whole, ("fear", "erst"): whole}
    assert {(r["label"], r["term"]): r["count"] for r in hits} == want
    assert {r["word"]: r["count"] for r in spans} == {"ontion": whole, "schaft": whole, "ing": whole, "eau": 2 * whole}
    assert [tuple(r) for r in n_scores] == [(4, 300)]
    assert took < 40


def test_places_count_code_points(spark):
    df = spark.createDataFrame([(1, "\U0001f319eau 春eau"), (2, None)], "doc_id int, text string")
    assert [(r["start"], r["term"]) for r in lexicon.interval_matches(df, {"joy": [("eau", 1.0)]}).orderBy("start").collect()] == [(1, "eau"), (6, "eau")]
    spans = lexicon.leftmost_spans(df, ["eau"], context=2).orderBy("match_no").collect()
    assert [tuple(r) for r in spans] == [(1, 1, "eau", 1, 4, "\U0001f319", " 春"), (1, 2, "eau", 6, 9, " 春", "")]
