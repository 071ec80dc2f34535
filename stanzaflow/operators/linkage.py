"""Record linkage and profiles: scores with unique winners, name resolution, placement, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import table_of
from .joins import interval_join
from .order import numbered
from .stylometry import first_k


def resolve_longest_prefix(rows: DataFrame, name: str, names: DataFrame, key: str, value: str, shortest: int = 2) -> DataFrame:
    """Adds ``value`` and ``method``: by the whole name, else by its longest prefix in the dictionary, else none.

    Prefixes are made of the rows, so the dictionary is joined by equality whatever its size.
    """
    lengths = F.sequence(F.lit(shortest), F.greatest(F.length(name), F.lit(shortest)))
    cut = rows.withColumn("_p", F.explode_outer(F.transform(lengths, lambda n: F.left(F.col(name), n))))
    hit = cut.join(names.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col("_p") == F.col("_k"), "left")
    best = hit.groupBy(*rows.columns).agg(F.max(F.when(F.col("_k").isNotNull(), F.struct(F.length("_k").alias("n"), F.col("_k").alias("k"), F.col("_v").alias("v")))).alias("_b"))
    method = F.when(F.col("_b").isNull(), "none").when(F.col("_b.k") == F.col(name), "exact").otherwise("prefix")
    return best.select(*rows.columns, F.col("_b.v").alias(value), method.alias("method"))


def resolve_in_steps(rows: DataFrame, steps: list[tuple[str, Column]], names: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` and ``step``: the first form of a name, in order, that the dictionary holds."""
    forms = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(label).alias("step"), form.alias("form")) for k, (label, form) in enumerate(steps)])
    tried = rows.withColumn("_f", F.explode(forms))
    hit = tried.join(names.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col("_f.form") == F.col("_k"), "left")
    best = hit.groupBy(*rows.columns).agg(F.min(F.when(F.col("_k").isNotNull(), F.struct("_f.no", "_f.step", "_v"))).alias("_b"))
    return best.select(*rows.columns, F.col("_b._v").alias(value), F.coalesce("_b.step", F.lit("none")).alias("step"))


def overlap_years(low1, high1, low2, high2) -> Column:
    """Years two closed intervals share, 0 if none."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.least(c(high1), c(high2)) - F.greatest(c(low1), c(low2)) + 1, F.lit(0))


def link_scores(local: DataFrame, other: DataFrame, name: str, score: Column, credible: Column, local_id: str, other_id: str, spans: tuple[tuple[str, str], tuple[str, str]] | None = None, bin_size: int = 20) -> DataFrame:
    """``local_id, match, score, state``: candidates share a name; the best credible one wins if it is alone at the top.

    With ``spans``, the year columns of both sides, only rows whose years overlap are candidates: they meet in bins of years,
    so a common name isn't one task.  ``score`` and ``credible`` are made of the columns beside the ids: rows that differ in
    nothing but their id are compared as one, so a common name costs as many pairs as it has different years and marks.
    """
    traits = F.struct(*[c for c in local.columns if c != local_id]).alias("_kind")
    kinds = local.select(traits).distinct().select("_kind", "_kind.*")
    classes = other.groupBy(*[c for c in other.columns if c != other_id]).agg(F.count("*").alias("_n"), F.min(other_id).alias("_o"))
    pairs = kinds.join(classes, name) if spans is None else interval_join(kinds, classes, name, *spans, bin_size)
    sums = [F.sum("_n").alias("_n"), F.min("_o").alias("_o")]
    top = F.max(F.struct("_s", F.col("_n").alias("ties"), "_o")).alias("b")
    tops = pairs.withColumn("_s", score).filter(credible).groupBy("_kind", "_s").agg(*sums).groupBy("_kind").agg(top)
    own = local.select(local_id, traits).join(tops, "_kind").select(local_id, "b._s", F.col("b.ties").alias("_n"), "b._o")
    best = own.groupBy(local_id, "_s").agg(*sums).groupBy(local_id).agg(top)
    out = local.select(local_id).join(best, local_id, "left")
    state = F.when(F.col("b").isNull(), "unmatched").when(F.col("b.ties") > 1, "ambiguous").otherwise("matched")
    return out.select(local_id, F.when(F.col("b.ties") == 1, F.col("b._o")).alias("match"), F.col("b._s").alias("score"), state.alias("state"))


def identity_audit(local: DataFrame, people: DataFrame, overrides: dict[str, int] | None = None, fixed: dict[str, list[int]] | None = None) -> DataFrame:
    """``name, person, score, reason, n_winners``: which person of an authority file a local name is, if exactly one scores best.

    ``local(name, low, high)`` are names with the years of their era, ``people(person, primary, aliases, low, high, years)`` persons with their names, the years of their
    own era (one end may be missing) and the years that are known of them.  Score: 100 if the eras overlap, 10 for each known year within the era,
    3 for the primary name, 1 for an alias; a person with neither overlap nor year is no candidate.  ``overrides`` bind a name to a person that bears it, ``fixed``
    names stay ambiguous.  ``reason``: ``unique_highest_score``, ``top_score_tie``, ``no_era_match``, ``override``, ``override_missing`` or ``fixed_homonyms``.
    """
    forms = people.select("person", F.explode(F.array_distinct(F.concat(F.array("primary"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"), "primary", "aliases", F.coalesce("low", "high").alias("_s"), F.coalesce("high", "low").alias("_e"), "years")
    met = local.join(forms, "name")
    overlap = F.coalesce((F.col("_s") <= F.col("high")) & (F.col("_e") >= F.col("low")), F.lit(False)).cast("int")
    dated = F.size(F.filter(F.coalesce("years", F.array().cast("array<int>")), lambda y: y.between(F.col("low"), F.col("high"))))
    score = 100 * overlap + 10 * dated + 3 * (F.col("name") == F.col("primary")).cast("int") + F.coalesce(F.array_contains("aliases", F.col("name")).cast("int"), F.lit(0))
    scored = met.select("name", "person", score.alias("_score"), ((overlap > 0) | (dated > 0)).alias("_fit"))
    tops = scored.filter("_fit").groupBy("name", "_score").agg(F.count("*").alias("n"), F.min("person").alias("p")).groupBy("name").agg(F.max(F.struct("_score", "n", "p")).alias("b"))
    bound = F.element_at(table_of(overrides or {}, "map<string,bigint>"), F.col("name"))
    bears = scored.withColumn("_bound", bound).filter(F.col("person") == F.col("_bound")).groupBy("name").agg(F.max("_score").alias("_bound_score"))
    out = local.select("name").distinct().withColumn("_bound", bound).join(tops, "name", "left").join(bears, "name", "left")
    stays = F.col("name").isin(list(fixed or {})) if fixed else F.lit(False)
    reason = (
        F.when(stays, "fixed_homonyms")
        .when(F.col("_bound").isNotNull() & F.col("_bound_score").isNotNull(), "override")
        .when(F.col("_bound").isNotNull(), "override_missing")
        .when(F.col("b").isNull(), "no_era_match")
        .when(F.col("b.n") > 1, "top_score_tie")
        .otherwise("unique_highest_score")
    )
    told = out.withColumn("reason", reason)
    person = F.when(F.col("reason") == "override", F.col("_bound")).when(F.col("reason") == "unique_highest_score", F.col("b.p").cast("bigint"))
    points = F.when(F.col("reason") == "override", F.col("_bound_score")).when(F.col("reason").isin("unique_highest_score", "top_score_tie"), F.col("b._score"))
    return told.select("name", person.alias("person"), points.alias("score"), "reason", F.when(F.col("reason") == "top_score_tie", F.col("b.n")).otherwise(F.when(person.isNotNull(), 1).otherwise(0)).cast("bigint").alias("n_winners"))


def variant_join(rows: DataFrame, row_id: str, title: str, variants: dict[str, Column], works: DataFrame, work_id: str, key: str) -> DataFrame:
    """``row_id, n_works, work, state``: works whose key equals a variant of the title; several works are ambiguous.

    Works with one key are counted by key before they meet the titles; only works with several keys are met one by one.
    """
    forms = rows.select(row_id, F.explode(F.array_distinct(F.array(*variants.values()))).alias("_k")).filter("_k <> ''").distinct()
    held = works.select(F.col(work_id).alias("_w"), F.col(key).alias("_k")).filter("_w is not null and _k is not null")
    keyed = held.groupBy("_w").agg(F.min("_k").alias("_k"), F.max("_k").alias("_last"))
    alone = keyed.filter("_k = _last").groupBy("_k").agg(F.count("*").alias("_n"), F.min("_w").alias("_w"))
    several = held.join(keyed.filter("_k <> _last").select("_w"), "_w", "left_semi")
    met = forms.join(alone, "_k").select(row_id, "_n", "_w").unionByName(forms.join(several, "_k").select(row_id, F.lit(1).cast("bigint").alias("_n"), "_w").distinct())
    hit = met.groupBy(row_id).agg(F.sum("_n").alias("n_works"), F.min("_w").alias("_w"))
    out = rows.select(row_id).join(hit, row_id, "left").withColumn("n_works", F.coalesce("n_works", F.lit(0)))
    state = F.when(F.col("n_works") == 0, "unmatched").when(F.col("n_works") > 1, "ambiguous").otherwise("matched")
    return out.select(row_id, "n_works", F.when(F.col("n_works") == 1, F.col("_w")).alias("work"), state.alias("state"))


def quoted_evidence(claims: DataFrame, docs: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """Adds ``literal``: the quote isn't empty and stands in its document word for word."""
    joined = claims.join(docs.select(key, text), key, "left")
    ok = F.coalesce(F.contains(F.col(text), F.col(quote)) & (F.length(F.trim(quote)) > 0), F.lit(False))
    return joined.withColumn("literal", ok).drop(text)


def interleave(main: DataFrame, second: DataFrame, order: str, every: int = 6) -> DataFrame:
    """``slot`` for the rows of both lists: after every ``every - 1`` rows of the first comes one of the second, then what is left.

    ``order`` is a total order of each list; rows may have any other columns, the same in both lists.
    """
    step = every - 1
    sizes = main.agg(F.count("*").alias("_main")).crossJoin(second.agg(F.count("*").alias("_second")))  # one row
    slot_a = F.col("_n") + F.least(F.floor(F.col("_n") / step), F.col("_second"))
    slot_b = F.when(F.col("_n") < F.floor(F.col("_main") / step), (F.col("_n") + 1) * every - 1).otherwise(F.col("_main") + F.col("_n"))
    a = numbered(main, order).crossJoin(F.broadcast(sizes)).withColumn("slot", slot_a.cast("bigint"))
    b = numbered(second, order).crossJoin(F.broadcast(sizes)).withColumn("slot", slot_b.cast("bigint"))
    return a.unionByName(b).drop("_n", "_main", "_second")


def replace_assets(old: DataFrame, new: DataFrame, done: DataFrame, asset: str, key: str, order: str) -> DataFrame:
    """Rows of assets that were read again are replaced; of rows with one key the first in order stays."""
    both = old.join(done, asset, "left_anti").unionByName(new.select(*old.columns))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def first_across_files(parts: list[DataFrame], keys: list[str], order: str, keep: Column) -> DataFrame:
    """Rows that are kept, each key from the first file and row that has it."""
    both = None
    for k, p in enumerate(parts):
        own = p.filter(keep).withColumn("_file", F.lit(k))
        both = own if both is None else both.unionByName(own)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_file", order))
    return both.withColumn("_n", place).filter("_n = 1").drop("_n")


def place_profile(rows: DataFrame, place: str, value: str, label: str, year: str, k: int = 3) -> DataFrame:
    """For each place: rows, mean value, the most common label, the ``k`` most common labels, first and last year."""
    counts = rows.groupBy(place, label).agg(F.count("*").alias("n"))
    ranked = first_k(counts, place, [F.desc("n"), label], k, "_r")
    tops = ranked.groupBy(place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", label))), lambda s: s[label]), ",").alias("top_labels"), F.max(F.when(F.col("_r") == 1, F.col(label))).alias("modal_label"))
    sums = rows.groupBy(place).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean_value"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return sums.join(tops, place)


def nested_documents(docs: DataFrame, lines: DataFrame, id_col: str, order: str, fields: list[str]) -> DataFrame:
    """Each document with its lines as an ordered array of structs."""
    own = lines.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("lines"))
    return docs.join(own, id_col, "left")


def candidate_rows(events: DataFrame, key: str, years: str, cited: Column) -> DataFrame:
    """``key, low, high, precision, grade`` from an array of years: exact if one, grade B only with a citation and one year."""
    low, high = F.array_min(years), F.array_max(years)
    exact = low == high
    return events.filter(low.isNotNull()).select(key, low.alias("low"), high.alias("high"), F.when(exact, "exact").otherwise("range").alias("precision"), F.when(exact & cited, "B").otherwise("C").alias("grade"))


def foreign_author_filter(rows: DataFrame, author: str, own: str) -> DataFrame:
    """Rows with another non-empty author go; rows without an author stay."""
    a = F.trim(F.coalesce(F.col(author), F.lit("")))
    return rows.filter((a == "") | (a == F.trim(own)))
