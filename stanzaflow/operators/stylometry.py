"""Statistics of lexicon hits by group: densities, shares, signatures, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_k(df: DataFrame, by, order, k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group in a total order; Spark cuts groups before the shuffle too."""
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def hits_per_100(docs_hits: DataFrame, group: str, hits: str, chars: str) -> DataFrame:
    """Hits for each hundred characters of a group; null for groups without characters."""
    sums = docs_hits.groupBy(group).agg(F.sum(hits).alias("hits"), F.sum(chars).alias("chars"))
    return sums.withColumn("per_100", F.round(F.col("hits") * 100.0 / F.nullif(F.col("chars"), F.lit(0)), 4))


def family_share(word_hits: DataFrame, group: str, family: str, hits: str, families: list[str]) -> DataFrame:
    """Share of a group's hits by family, all families listed, zeros included."""
    spark = word_hits.sparkSession
    sums = word_hits.groupBy(group, family).agg(F.sum(hits).alias("hits"))
    every = word_hits.select(group).distinct().join(F.broadcast(spark.createDataFrame([(f,) for f in families], f"{family} string")))
    total = F.sum("hits").over(W.partitionBy(group))
    full = every.join(sums, [group, family], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
    return full.withColumn("share", F.round(F.coalesce(F.col("hits") / F.nullif(total, F.lit(0)), F.lit(0.0)), 4))


def smoothed_ratio(bright, dark) -> Column:
    """(b + 1) / (d + 1)."""
    return (F.col(bright) + 1.0) / (F.col(dark) + 1.0)


def signature(word_hits: DataFrame, group: str, word: str, hits: str, k: int = 6, least: int = 2) -> DataFrame:
    """``k`` words that mark a group: by hits times lift first, then filled up by hits.

    Lift is the group's share of the word over the corpus share; words with fewer than ``least`` hits only fill up.
    """
    sums = word_hits.groupBy(group, word).agg(F.sum(hits).alias("n"))
    of_group = F.sum("n").over(W.partitionBy(group))
    of_word = F.sum("n").over(W.partitionBy(word))
    total = sums.agg(F.sum("n").alias("_all"))  # one row, from the same shuffle as the sums
    scored = sums.withColumn("_g", of_group).withColumn("_w", of_word).crossJoin(F.broadcast(total))
    lift = (F.col("n") / F.col("_g")) / (F.col("_w") / F.col("_all"))
    scored = scored.withColumn("lift", F.round(lift, 6)).withColumn("_first", (F.col("n") < least).cast("int"))
    score = F.when(F.col("_first") == 0, F.round(F.col("n") * F.col("lift"), 6)).otherwise(F.lit(0.0))
    ranked = first_k(scored.withColumn("score", score), group, ["_first", F.desc("score"), F.desc("n"), word], k, "place")
    return ranked.select(group, word, "n", "lift", "place")


def quiet_ratio(docs_hits: DataFrame, group: str, hits: str) -> DataFrame:
    """Share of a group's documents without any hit."""
    quiet = F.avg(F.when(F.coalesce(F.col(hits), F.lit(0)) == 0, 1.0).otherwise(0.0))
    return docs_hits.groupBy(group).agg(F.count("*").alias("docs"), F.round(quiet, 6).alias("quiet_ratio"))


def qualified_ranking(rates: DataFrame, group: str, rate: str, size: str, least: int) -> DataFrame:
    """Rank of the groups that are large enough, the median over them, and the others marked as small."""
    fit = F.col(size) >= least
    mid = rates.filter(fit).agg(F.round(F.median(rate), 6).alias("median"))  # one row
    place = F.row_number().over(W.partitionBy(fit).orderBy(F.desc(rate), group))  # one row for each group
    out = rates.crossJoin(F.broadcast(mid)).withColumn("place", F.when(fit, place))
    return out.withColumn("small_outlier", ~fit & (F.col(rate) > F.col("median")))


def lift_matrix(pairs: DataFrame, docs: DataFrame, item: str, label: str, least_item: int = 50, least_cell: int = 5, k: int = 10) -> DataFrame:
    """P(label | item) / P(label) over documents, for cells with support, the ``k`` best of each item above 1.

    ``pairs(id, item, label)`` holds each item of a document once; ``docs(id, label)`` all documents.
    """
    n_label = docs.groupBy(label).agg(F.count("*").alias("n_label"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))  # one row
    cells = pairs.groupBy(item, label).agg(F.count("*").alias("n_cell"))
    items = cells.groupBy(item).agg(F.sum("n_cell").alias("n_item"))
    lift = (F.col("n_cell") / F.col("n_item")) / (F.col("n_label") / F.col("n_docs"))
    scored = cells.join(items, item).join(n_label, label).crossJoin(F.broadcast(n_docs)).withColumn("lift", F.round(lift, 6))
    good = scored.filter((F.col("n_item") >= least_item) & (F.col("n_cell") >= least_cell) & (F.col("lift") > 1.0))
    return first_k(good, item, [F.desc("lift"), F.desc("n_cell"), label], k).select(item, label, "n_item", "n_cell", "lift", "place")


def conditional_lift(docs: DataFrame, group: str, items: str, labels: str) -> DataFrame:
    """``group, item, label, p_item, p_base, lift``: P(label | item, group), P(label | group) and their ratio, null where the baseline is 0.

    ``items`` and ``labels`` are arrays of distinct values of a document.  P(label | item) is over the documents with the item
    that have a label.  Each document is counted once for each cell, in one pass and one shuffle.
    """
    none = F.lit(None).cast("string")
    pair = lambda i, la: F.struct(i.alias("item"), la.alias("label"))
    with_labels = F.when(F.size(labels) > 0, F.transform(items, lambda i: pair(i, none))).otherwise(F.array().cast("array<struct<item:string,label:string>>"))
    cells = F.concat(
        F.array(pair(none, none)),
        F.transform(labels, lambda la: pair(none, la)),
        with_labels,
        F.flatten(F.transform(items, lambda i: F.transform(labels, lambda la: pair(i, la)))),
    )
    counts = docs.select(F.col(group), F.explode(cells).alias("c")).groupBy(group, "c.item", "c.label").agg(F.count("*").alias("n"))
    size = counts.filter("item is null and label is null").select(group, F.col("n").alias("n_group"))
    base = counts.filter("item is null and label is not null").select(group, "label", F.col("n").alias("n_base"))
    n_item = counts.filter("item is not null and label is null").select(group, "item", F.col("n").alias("n_item"))
    out = counts.filter("item is not null and label is not null").join(n_item, [group, "item"]).join(base, [group, "label"]).join(size, group)
    p_item = F.col("n") / F.col("n_item")
    p_base = F.col("n_base") / F.col("n_group")
    return out.select(group, "item", "label", F.round(p_item, 6).alias("p_item"), F.round(p_base, 6).alias("p_base"), F.round(p_item / F.nullif(p_base, F.lit(0.0)), 6).alias("lift"))


def dominant_label(hits: DataFrame, id_col: str, label: str, position: str) -> DataFrame:
    """The label met most often in a document; ties go to the one met first."""
    counts = hits.groupBy(id_col, label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("early"), label)).alias("b")
    return counts.groupBy(id_col).agg(best).select(id_col, F.col(f"b.{label}").alias(label), F.col("b.n").alias("n"))


def rate_contrast(hits: DataFrame, sizes: DataFrame, word: str, side: str, left: str, right: str, k: int) -> DataFrame:
    """Hits for each 10 000 characters on two sides and the words that differ most."""
    total = sizes.groupBy(side).agg(F.sum("chars").alias("chars"))
    rates = hits.groupBy(word, side).agg(F.sum("hits").alias("hits")).join(total, side).withColumn("rate", F.col("hits") * 10000.0 / F.col("chars"))
    wide = rates.groupBy(word).agg(
        F.coalesce(F.max(F.when(F.col(side) == left, F.col("rate"))), F.lit(0.0)).alias("left_rate"),
        F.coalesce(F.max(F.when(F.col(side) == right, F.col("rate"))), F.lit(0.0)).alias("right_rate"),
    )
    delta = wide.select(word, F.round("left_rate", 4).alias("left_rate"), F.round("right_rate", 4).alias("right_rate"), F.round(F.col("right_rate") - F.col("left_rate"), 4).alias("delta"))
    return delta.orderBy(F.desc(F.abs("delta")), word).limit(k)


def palette(word_hits: DataFrame, group: str, shade: str, hits: str, k: int = 8) -> DataFrame:
    """``group, shade, n, place``: the ``k`` shades a group uses most, ties by name."""
    sums = word_hits.groupBy(group, shade).agg(F.sum(hits).alias("n"))
    return first_k(sums, group, [F.desc("n"), shade], k)


def headline(groups: DataFrame, group: str, docs: str, hits: str, sides: dict[str, list[str]], least_docs: int = 10, least_hits: int = 40) -> DataFrame:
    """``group, side, share, corpus_share, ratio``: the group whose share of a side lies furthest above the corpus, one row.

    ``groups`` has a row for each group with its documents, hits and hits by family; ``sides`` lists the families of each side.
    The corpus share weighs groups by hits; groups with few documents or hits can't win; ties go by side and group.
    """
    total = groups.agg(F.sum(hits).alias("_all"), *[F.sum(sum((F.col(f) for f in fams), F.lit(0))).alias(f"_{s}") for s, fams in sides.items()])  # one row
    fit = groups.filter((F.col(docs) >= least_docs) & (F.col(hits) >= least_hits)).crossJoin(F.broadcast(total))
    own = [F.struct(F.lit(s).alias("side"), (sum((F.col(f) for f in fams), F.lit(0)) / F.col(hits)).alias("share"), (F.col(f"_{s}") / F.col("_all")).alias("corpus_share")) for s, fams in sides.items()]
    rows = fit.select(group, F.explode(F.array(*own)).alias("_x")).select(group, "_x.*").filter("corpus_share > 0")
    ratio = F.round(F.col("share") / F.col("corpus_share"), 6)
    out = rows.select(group, "side", F.round("share", 6).alias("share"), F.round("corpus_share", 6).alias("corpus_share"), ratio.alias("ratio"))
    return out.orderBy(F.desc("ratio"), "side", group).limit(1)


def number_kinds(matches: DataFrame, group: str, kind: str, size: str, apart: tuple[str, ...] = ("weak", "ordinal"), huge: float = 3.0) -> DataFrame:
    """``group, counted, weak, ordinal, mean_size, huge``: number words of a group, the kinds ``apart`` counted beside the others."""
    counted = ~F.col(kind).isin(*apart)
    return matches.groupBy(group).agg(
        F.count_if(counted).alias("counted"),
        *[F.count_if(F.col(kind) == a).alias(a) for a in apart],
        F.round(F.avg(F.when(counted, F.col(size))), 6).alias("mean_size"),
        F.count_if(counted & (F.col(size) >= huge)).alias("huge"),
    )


def top_expressions(matches: DataFrame, group: str, size: str, word: str, line: str, k: int = 5) -> DataFrame:
    """The ``k`` largest expressions of a group, each line once, with its largest word."""
    best = matches.groupBy(group, line).agg(F.max(F.struct(F.col(size).alias("size"), F.col(word).alias("word"))).alias("b"))
    return first_k(best.select(group, line, "b.size", "b.word"), group, [F.desc("size"), "word", line], k)


def weighted_density(matches: DataFrame, sizes: DataFrame, group: str, category: str, intensity: str, chars: str, pair: tuple[str, str]) -> DataFrame:
    """``group, hits, weight, density, n_first, n_second, ratio``: hits by intensity for each 100 characters, and how the two categories of ``pair`` compare.

    ``matches(group, category, intensity)`` have a row for each hit, ``sizes(group, chars)`` a row or more for each group; a group without
    hits has density 0.  The ratio is null where the second category is never met.
    """
    own = matches.groupBy(group).agg(
        F.count("*").alias("hits"), F.sum(intensity).alias("weight"), F.count_if(F.col(category) == pair[0]).alias("n_first"), F.count_if(F.col(category) == pair[1]).alias("n_second")
    )
    total = sizes.groupBy(group).agg(F.sum(chars).alias("_chars")).join(own, group, "left").na.fill(0, ["hits", "weight", "n_first", "n_second"])
    density = F.round(F.col("weight") * 100.0 / F.nullif(F.col("_chars"), F.lit(0)), 6)
    return total.select(group, "hits", "weight", density.alias("density"), "n_first", "n_second", F.round(F.col("n_first") / F.nullif(F.col("n_second"), F.lit(0)), 6).alias("ratio"))


def capped_picks(candidates: DataFrame, item: str, group: str, order: list, cap: int, target: int, topped_up: Column, least: int) -> DataFrame:
    """``candidates`` with ``pass``: 1 for the first ``target`` in order with at most ``cap`` of a group, 2 for those that top up.

    If fewer than ``least`` of the first picks are ``topped_up`` ones, further such candidates follow in the same order, as far as their groups have room.
    ``order`` is total.  Nothing but the first picks' counts comes to the driver.
    """
    ranked = candidates.withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    first = ranked.filter(F.col("_g") <= cap).orderBy(*order).limit(target)
    picked = first.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(topped_up).alias("_top"))  # as many rows as picks at most
    missing = least - (picked.agg(F.sum("_top")).first()[0] or 0)
    out = first.withColumn("pass", F.lit(1))
    if missing > 0:
        rest = ranked.filter(topped_up).join(first.select(item), item, "left_anti").join(picked.select(group, "_n"), group, "left")
        place = F.row_number().over(W.partitionBy(group).orderBy(*order))
        more = rest.withColumn("_p", place).filter(F.col("_p") <= cap - F.coalesce("_n", F.lit(0))).orderBy(*order).limit(missing)
        out = out.unionByName(more.drop("_n", "_p").withColumn("pass", F.lit(2)))
    return out.drop("_g")
