"""Affect: scores of weighted terms turned into labels, dimensions and confidence; seasons by clue words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .lexicon import MASK, by_length
from ..functions.arrays import let, literal, table_of
from ..functions.text import text_of

TITLE_SHARE = 0.55  # weight of a hit in the title against one in the body
POWER = 1.12


# fixed values: the record of a document without a signal
NO_SIGNAL = {"valence": 0.0, "arousal": 0.35, "dominance": 0.0, "confidence": 0.12}


def emotion_scores(body_hits: DataFrame, title_hits: DataFrame | None = None, cluster_hits: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id, label, score, rule_hits`` from hits ``(id, label, weight)``.

    A title hit counts ``TITLE_SHARE`` of its weight, a hit of a fall-back cluster ``(id, label, weight, hits)`` its weight as
    often as it was met; neither counts as a rule hit.
    """
    both = body_hits.select(id_col, "label", F.col("weight").alias("w"), F.lit(1).alias("h"))
    if title_hits is not None:
        both = both.unionByName(title_hits.select(id_col, "label", (F.col("weight") * TITLE_SHARE).alias("w"), F.lit(0).alias("h")))
    if cluster_hits is not None:
        both = both.unionByName(cluster_hits.select(id_col, "label", (F.col("weight") * F.col("hits")).alias("w"), F.lit(0).alias("h")))
    return both.groupBy(id_col, "label").agg(F.sum("w").alias("score"), F.sum("h").alias("rule_hits")).filter("score > 0")


def document_scores(docs: DataFrame, terms: dict[str, list[tuple[str, float]]], clusters: dict[str, tuple[str, float]], title_col: str, body_col: str, id_col: str = "doc_id", excluded=(), negators=(), single=None, keep: list[str] | None = None) -> DataFrame:
    """``id, scores``, and the columns ``keep``: ``array<struct<label, score, rule_hits>>`` of each document, worked out within its row.

    ``terms`` by label are matched by intervals in body and title; ``clusters`` gives the label and weight of fall-back words,
    counted in the body by masking.
    """
    keep = keep or []
    whole = docs.select(
        F.col(id_col), *keep,
        lexicon.accepted_by_label(body_col, terms, excluded, negators, single).alias("_body"),
        lexicon.accepted_by_label(title_col, terms, excluded, negators, single).alias("_title"),
        lexicon.masked_counts(body_col, clusters).alias("_c"),
    )
    table = table_of({w: {"label": label, "weight": float(weight)} for w, (label, weight) in clusters.items()}, "map<string,struct<label:string,weight:double>>")
    weights = lambda hits: F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["weight"])

    def cluster(label: Column) -> Column:
        own = lambda h: F.element_at(table, h["word"])
        return F.aggregate("_c", F.lit(0.0), lambda a, h: a + F.when(own(h)["label"] == label, own(h)["weight"] * h["hits"]).otherwise(F.lit(0.0)))

    def entry(b: Column, t: Column) -> Column:
        score = weights(b["hits"]) + weights(t["hits"]) * TITLE_SHARE
        score = score + cluster(b["label"]) if clusters else score
        return F.struct(b["label"].alias("label"), F.round(score, 9).alias("score"), F.size(b["hits"]).cast("bigint").alias("rule_hits"))

    return whole.select(id_col, *keep, F.filter(F.zip_with("_body", "_title", entry), lambda e: e["score"] > 0).alias("scores"))


def profile_of(scores, dimensions: list[tuple[str, float, float, float]]) -> Column:
    """A document's profile from its ``array<struct<label, score, rule_hits>>``, by the rules of ``emotion_profile``."""
    kind = "array<struct<down:double,label:string,score:double,hits:bigint,valence:double,arousal:double,dominance:double,power:double>>"
    signed = {d: F.create_map(*[F.lit(v) for row in dimensions for v in (row[0], float(row[1 + k]))]) for k, d in enumerate(("valence", "arousal", "dominance"))}

    def entry(e: Column) -> Column:
        own = [F.element_at(t, e["label"]).alias(d) for d, t in signed.items()]
        return F.struct((-e["score"]).alias("down"), e["label"].alias("label"), e["score"].alias("score"), e["rule_hits"].alias("hits"), *own, F.pow(e["score"], F.lit(POWER)).alias("power"))

    def summed(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, e: a + f(e))

    def record(ranked: Column) -> Column:
        first = F.slice(ranked, 1, 8)
        sums = F.struct(
            summed(ranked, lambda e: e["score"]).alias("total"),
            F.get(ranked, F.lit(0))["score"].alias("top"),
            F.aggregate(ranked, F.lit(0).cast("bigint"), lambda a, e: a + e["hits"]).alias("hits"),
            summed(F.filter(ranked, lambda e: e["valence"] > 0.2), lambda e: e["score"]).alias("positive"),
            summed(F.filter(ranked, lambda e: e["valence"] < -0.2), lambda e: e["score"]).alias("negative"),
            summed(first, lambda e: e["power"]).alias("power"),
            *[summed(first, lambda e: e["power"] * e[d]).alias(d) for d in signed],
        )
        return let(sums, lambda s: let(F.least(F.lit(0.96), 0.18 + 0.38 * (1 - F.exp(-s["total"] / 4.2)) + 0.24 * s["top"] / s["total"] + 0.16 * F.least(F.lit(1.0), s["hits"] / 5.0)), lambda c: fields(ranked, s, c)))

    def fields(ranked: Column, s: Column, confidence: Column) -> Column:
        some = s["total"] > 0
        listed = F.transform(F.slice(ranked, 1, 3), lambda e: F.struct(e["label"].alias("label"), F.round(e["score"], 4).alias("score"), F.round(e["score"] / s["total"], 4).alias("share")))
        return F.struct(
            F.get(ranked, F.lit(0))["label"].alias("primary"),
            *[F.when(some, F.round(s[d] / s["power"], 3)).otherwise(F.lit(NO_SIGNAL[d])).alias(d) for d in signed],
            listed.alias("labels"),
            F.when(some, (s["positive"] / s["total"] >= 0.22) & (s["negative"] / s["total"] >= 0.22)).otherwise(F.lit(False)).alias("mixed"),
            F.when(some, F.round(confidence, 3)).otherwise(F.lit(NO_SIGNAL["confidence"])).alias("confidence"),
            F.when(some & (confidence >= 0.72), "high").when(some & (confidence >= 0.48), "medium").otherwise("low").alias("confidence_label"),
            s["hits"].alias("rule_hits"),
        )

    ranked = F.array_sort(F.coalesce(F.transform(scores, entry), F.array()).cast(kind))
    return let(ranked, record)


def emotion_profile(scores: DataFrame, dimensions: list[tuple[str, float, float, float]], id_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """One row for each document: primary label, dimensions, mixture and confidence.

    ``dimensions(label, valence, arousal, dominance)`` is a lexicon.  The first eight labels by score carry the dimensions,
    weighted by score to the power 1.12; the first three are listed.  With ``docs``, documents without scores get the fixed
    record of no signal.
    """
    known = F.col("label").isin([d[0] for d in dimensions])
    own = scores.filter(known).groupBy(id_col).agg(F.collect_list(F.struct("label", "score", "rule_hits")).alias("_s"))  # a row for each label at most
    whole = own if docs is None else docs.select(id_col).join(own, id_col, "left")
    return whole.select(id_col, profile_of(F.col("_s"), dimensions).alias("p")).select(id_col, "p.*")


def label_distribution(profiles: DataFrame, owner: str) -> DataFrame:
    """``kind, owner, label, n``: documents by primary label, by owner and primary label (both without undecided ones), and by confidence."""
    none = F.lit(None).cast("string")
    row = lambda kind, of, label: F.struct(F.lit(kind).alias("kind"), of.alias(owner), label.alias("label"))
    decided = lambda x: F.when(F.col("primary").isNotNull(), x)
    cells = [decided(row("label", none, F.col("primary"))), decided(row("owner", F.col(owner).cast("string"), F.col("primary"))), row("confidence", none, F.col("confidence_label"))]
    # the profile is worked out once for its three counters
    return profiles.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.kind", f"c.{owner}", "c.label").agg(F.count("*").alias("n"))


def percent_of(value, signed: bool = True) -> Column:
    """A dimension as 0 to 100: from -1 to 1 if it has a sign, else from 0 to 1; halves go to the even number."""
    low = F.lit(-1.0 if signed else 0.0)
    inside = F.greatest(low, F.least(F.lit(1.0), F.col(value) if isinstance(value, str) else value))
    return F.bround((inside + 1) * 50 if signed else inside * 100, 0).cast("int")


_TERMS = "array<struct<word:string,points:int,mask:string,pattern:string>>"


def _clue_rows(terms: dict[str, int]) -> list[dict]:
    return [{"word": w, "points": terms[w], "mask": MASK * len(w), "pattern": literal(w)} for w in by_length(terms)]


def _clues(text: Column, terms: Column) -> Column:
    start = F.struct(text.alias("t"), F.lit(0).alias("score"), F.lit(-1).alias("latest"))

    def step(acc: Column, e: Column) -> Column:
        gone = F.octet_length(acc["t"]) - F.octet_length(F.replace(acc["t"], e["word"], F.lit("")))
        hits = (gone / F.octet_length(e["word"])).cast("int")
        behind = F.element_at(F.split(acc["t"], e["pattern"], F.lit(-1)), -1)  # the text behind the last hit
        last = F.when(hits > 0, F.length(acc["t"]) - F.length(behind) - F.length(e["word"])).otherwise(F.lit(-1))
        return F.struct(
            F.replace(acc["t"], e["word"], e["mask"]).alias("t"),
            (acc["score"] + hits * e["points"]).alias("score"),
            F.greatest(acc["latest"], last).alias("latest"),
        )

    done = F.aggregate(F.filter(terms, lambda e: F.contains(text, e["word"])), start, step)
    return let(done, lambda d: F.struct(d["score"].alias("score"), d["latest"].alias("latest")))


def clue_score(x, terms: dict[str, int]) -> Column:
    """``struct<score, latest>`` of weighted words, longest first with masking; ``latest`` is the last hit's 0-based place or -1.

    Only words that occur at all are walked through.
    """
    return let(text_of(x), lambda t: _clues(t, table_of(_clue_rows(terms), _TERMS)))


def detect_season(docs: DataFrame, seasons: dict[str, dict[str, int]], title_col: str, body_col: str, id_col: str = "doc_id", title_weight: int = 3) -> DataFrame:
    """``id, season, score, tied``: the season with the highest score; ties go to the clue met last, then to season order.

    ``tied`` counts the seasons that share the highest score, 0 without any clue.
    """
    rows = [{"season": name, "early": -k, "terms": _clue_rows(terms)} for k, (name, terms) in enumerate(seasons.items())]
    table = table_of(rows, f"array<struct<season:string,early:int,terms:{_TERMS}>>")

    def entry(title: Column, body: Column, s: Column) -> Column:
        def joined(t: Column, b: Column) -> Column:
            latest = F.greatest(t["latest"], F.when(b["latest"] >= 0, F.length(title) + 1 + b["latest"]).otherwise(F.lit(-1)))
            return F.struct((t["score"] * title_weight + b["score"]).alias("score"), latest.alias("latest"), s["early"].alias("early"), s["season"].alias("season"))

        return let(_clues(title, s["terms"]), lambda t: let(_clues(body, s["terms"]), lambda b: joined(t, b)))

    scored = let(text_of(title_col), lambda title: let(text_of(body_col), lambda body: F.filter(F.transform(table, lambda s: entry(title, body, s)), lambda e: e["score"] > 0)))
    found = docs.select(F.col(id_col), scored.alias("_all")).withColumn("_best", F.array_max("_all"))
    tied = F.size(F.filter("_all", lambda e: e["score"] == F.col("_best.score")))
    return found.select(id_col, F.col("_best.season").alias("season"), F.coalesce("_best.score", F.lit(0)).alias("score"), tied.alias("tied"))


def confidence_for(grade, match, agreeing, conflict, bases: dict[str, float]) -> Column:
    """base[grade] * match, +0.05 with two agreeing sources, -0.20 on conflict, within 0 and 0.99, three places."""
    table = F.create_map(*[v for g, b in bases.items() for v in (F.lit(g), F.lit(float(b)))])
    base = F.coalesce(F.element_at(table, F.col(grade)), F.lit(0.0))
    raw = base * F.col(match) + F.when(F.col(agreeing) >= 2, 0.05).otherwise(0.0) - F.when(F.col(conflict), 0.20).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), raw)), 3)
