"""Places as archives: who wrote about them, who wrote there, and what their poems hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import table_of
from ..functions.text import text_of
from .stylometry import first_k

IMAGERY_PER_DOCUMENT = 10  # fixed value: of a long document no more words count, in the order of the lexicon
TOP_IMAGERY = 8


def mentions(docs: DataFrame, aliases: dict[str, str], imagery: dict[str, float], seasons: dict[str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``place`` for each place a document names, once each, with the columns ``keep``, ``words`` and ``season_counts``.

    A place is named by an alias of two characters or more.  ``words`` are the first ``IMAGERY_PER_DOCUMENT`` words of the lexicon that the text holds, with
    their values; ``season_counts`` tells how often each season's sign stands in it.  Everything is found within the document's row.
    """
    text = text_of(text_col)
    names = {a: p for a, p in aliases.items() if len(a) >= 2}
    if not names:
        raise ValueError("no alias has two characters")
    held = F.filter(F.lit(list(names)), lambda a: F.contains(text, a))
    places = F.array_distinct(F.transform(held, lambda a: F.element_at(table_of(names, "map<string,string>"), a)))
    lexicon = table_of([{"word": w, "value": v} for w, v in imagery.items()], "array<struct<word:string,value:double>>")
    words = F.slice(F.filter(lexicon, lambda e: F.contains(text, e["word"])), 1, IMAGERY_PER_DOCUMENT)
    counts = F.array(*[F.struct(F.lit(s).alias("season"), ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("bigint").alias("n")) for s, w in seasons.items()])
    rows = docs.select(*(keep or []), places.alias("_places"), words.alias("words"), counts.alias("season_counts")).filter(F.size("_places") > 0)
    return rows.select(*(keep or []), F.explode("_places").alias("place"), "words", "season_counts")


def _mode(counts: DataFrame, item: str, n: str, name: str, ranks: list[str] | None = None) -> DataFrame:
    """The item of each place with the greatest ``n``; ties by the order of ``ranks``, else by the item."""
    tie: Column = F.array_position(F.lit(ranks), F.col(item)) if ranks else F.lit(0)
    return counts.groupBy("place").agg(F.min(F.struct((-F.col(n)).alias("n"), tie.alias("t"), F.col(item).alias("x"))).alias("_m")).select("place", F.col("_m.x").alias(name))


def archives(met: DataFrame, composed: DataFrame, gazetteer: DataFrame, owner: str, valence: str, label: str, seasons: list[str]) -> DataFrame:
    """One row for each place that is written about or was written at and has coordinates.

    ``met`` as ``mentions`` gives it, with ``owner``, ``valence`` and ``label``; ``composed(place, lon, lat, grade)`` are works placed there, of which those of grade A or B
    with coordinates count; ``gazetteer(place, lon, lat)`` knows places by name.  ``place, lon, lat, composed_n, mentions_n, owners_n, locality`` (works
    composed there among all that touch it) ``, mean_valence`` (of documents with imagery) ``, modal_label, top_season, imagery`` (the most common words as
    structs of ``word, n, mean``).  Coordinates are those of the works (the smallest), else the gazetteer's.
    """
    there = composed.filter(F.col("grade").isin("A", "B") & F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.coalesce("place", F.lit("")) != ""))
    works = there.groupBy("place").agg(F.count("*").alias("composed_n"), F.min(F.struct("lon", "lat")).alias("_at"))
    known = gazetteer.groupBy("place").agg(F.min(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("lon", "lat"))).alias("_known"))
    sums = met.groupBy("place").agg(F.count("*").alias("mentions_n"), F.countDistinct(owner).alias("owners_n"), F.round(F.avg(F.when(F.size("words") > 0, F.col(valence))), 3).alias("mean_valence"))
    modal = _mode(met.groupBy("place", label).agg(F.count("*").alias("n")), label, "n", "modal_label")
    by_season = met.select("place", F.explode("season_counts").alias("s")).groupBy("place", "s.season").agg(F.sum("s.n").alias("n")).filter("n > 0")
    season = _mode(by_season, "season", "n", "top_season", seasons)
    words = met.select("place", F.explode("words").alias("w")).groupBy("place", "w.word").agg(F.count("*").alias("n"), F.round(F.avg("w.value"), 3).alias("mean"))
    top = first_k(words, "place", [F.desc("n"), "word"], TOP_IMAGERY, "_r").groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "word", "n", "mean"))), lambda e: F.struct(e["word"].alias("word"), e["n"].alias("n"), e["mean"].alias("mean"))).alias("imagery"))
    both = works.join(sums, "place", "full").na.fill(0, ["composed_n", "mentions_n", "owners_n"])
    for side in (known, modal, season, top):
        both = both.join(side, "place", "left")
    at = F.coalesce("_at", "_known")
    rate = F.round(F.col("composed_n") / (F.col("composed_n") + F.col("mentions_n")), 4)
    out = both.filter(at.isNotNull()).select(
        "place", at["lon"].alias("lon"), at["lat"].alias("lat"), "composed_n", "mentions_n", "owners_n", rate.alias("locality"), "mean_valence", "modal_label", "top_season",
        F.coalesce("imagery", F.array().cast(top.schema["imagery"].dataType)).alias("imagery"),
    )
    return out
