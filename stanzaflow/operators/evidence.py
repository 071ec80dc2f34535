"""Evidence from several sources: agreement, conflict, gates, unique winners, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_agreement(claims: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """``key, value, agreeing, n_values, conflict``: sources behind each value, and whether a key has several values."""
    per_value = claims.groupBy(key, value).agg(F.countDistinct(source).alias("agreeing"))
    n_values = F.count("*").over(W.partitionBy(key))
    return per_value.withColumn("n_values", n_values).withColumn("conflict", F.col("n_values") > 1)


def interval_conflict(claims: DataFrame, key: str, start: str, end: str, source: str) -> DataFrame:
    """A key's dates conflict if some start lies behind some end, with two intervals and two sources at least."""
    g = claims.groupBy(key).agg(F.max(start).alias("latest_start"), F.min(end).alias("earliest_end"), F.count("*").alias("n"), F.countDistinct(source).alias("sources"))
    return g.withColumn("conflict", (F.col("latest_start") > F.col("earliest_end")) & (F.col("n") >= 2) & (F.col("sources") >= 2))


def dual_source_gate(claims: DataFrame, key: str, family: str, year: str, tolerance: int = 1, least: int = 2) -> DataFrame:
    """Keys whose families, each by its earliest year, are at least ``least`` and differ by ``tolerance`` at most."""
    first = claims.filter(F.col(year).isNotNull() & F.col(family).isNotNull()).groupBy(key, family).agg(F.min(year).alias("y"))
    gate = first.groupBy(key).agg(F.count("*").alias("families"), F.min("y").alias("low"), F.max("y").alias("high"))
    return gate.filter((F.col("families") >= least) & (F.col("high") - F.col("low") <= tolerance))


def ordered_rules(claims: DataFrame, key: str, family: str, year: str, single: list[tuple[str, str]], exact: int = 1, wide: int = 3) -> DataFrame:
    """``key, rule, low, high``: which promotion rule a key meets.

    With two families or more the gap decides (``dual_exact``, ``dual_range``, ``gap_too_large``); a single family
    is looked up in ``single``, a list of (family, rule) in order; others are ``none``.
    """
    first = claims.filter(F.col(year).isNotNull()).groupBy(key, family).agg(F.min(year).alias("y"))
    g = first.groupBy(key).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.min(family).alias("_f"))
    gap = F.col("high") - F.col("low")
    rule: Column = F.when((F.col("n") >= 2) & (gap <= exact), "dual_exact").when((F.col("n") >= 2) & (gap <= wide), "dual_range").when(F.col("n") >= 2, "gap_too_large")
    for name, label in single:
        rule = rule.when(F.col("_f") == name, label)
    return g.select(key, rule.otherwise("none").alias("rule"), "low", "high")


def publishable(claims: DataFrame, key: str, value: str, source: str, grade: str) -> DataFrame:
    """Grades A and B always, C only where two sources give an equal value; a value that isn't known is equal to none.

    Values with two sources are summed up by key and value, and only they are joined to the claims.
    """
    shared = claims.filter(F.col(value).isNotNull()).groupBy(key, value).agg((F.min(source) < F.max(source)).alias("_shared")).filter("_shared")
    grades = F.col(grade).isin("A", "B") | ((F.col(grade) == "C") & F.coalesce("_shared", F.lit(False)))
    return claims.join(shared, [key, value], "left").select(*claims.columns, grades.alias("publish"))


def unique_winner(candidates: DataFrame, key: str, candidate: str, score: Column) -> DataFrame:
    """``key, winner, top_score, ties``: the best candidate if it is alone at the top, else none."""
    scored = candidates.withColumn("_s", score)
    g = scored.groupBy(key, "_s").agg(F.count("*").alias("ties"), F.min(candidate).alias("_c"))
    best = g.groupBy(key).agg(F.max(F.struct("_s", "ties", "_c")).alias("b"))
    return best.select(key, F.when(F.col("b.ties") == 1, F.col("b._c")).alias("winner"), F.col("b._s").alias("top_score"), F.col("b.ties").alias("ties"))


def funnel(rows: DataFrame, reasons: list[tuple[str, Column]], last: str) -> DataFrame:
    """``reason, n``: each row goes to the first reason that holds, else to ``last``."""
    chain = None
    for name, holds in reasons:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    return rows.groupBy(chain.otherwise(last).alias("reason")).agg(F.count("*").alias("n"))


def package_errors(packages: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``, the names of the rules a row breaks (a rule that is null counts as broken)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return packages.withColumn("errors", F.array_compact(F.array(*checks)))


def best_record(claims: DataFrame, key: str, order: list, values: list[str], source: str) -> DataFrame:
    """One record for each key: the best claim's values, the distinct sources, and the other values as notes."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    ranked = claims.withColumn("_n", place)
    first = [F.max(F.when(F.col("_n") == 1, F.col(v))).alias(v) for v in values]
    return ranked.groupBy(key).agg(*first, F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n_claims"), F.countDistinct(values[0]).alias("n_values"))


def conflict_and_gap(works: DataFrame, windows: DataFrame, key: str, work_id: str, year: str, place: str) -> DataFrame:
    """``n_works, n_conflict, n_gap`` against reviewed windows ``(key, win_start, win_end, win_place)``.

    A work conflicts if a window holds its year and names another place; it is a gap if no window holds its year.
    """
    held = works.join(windows, key, "left").withColumn("_in", F.coalesce(F.col(year).between(F.col("win_start"), F.col("win_end")), F.lit(False)))
    other = F.col("_in") & (F.coalesce(F.col(place), F.lit("")) != "") & (F.coalesce(F.col("win_place"), F.lit("")) != "") & (F.col(place) != F.col("win_place"))
    each = held.groupBy(key, work_id).agg(F.max("_in").alias("_any"), F.max(other).alias("_other"))
    return each.groupBy(key).agg(F.count("*").alias("n_works"), F.count_if("_other").alias("n_conflict"), F.count_if(~F.col("_any")).alias("n_gap"))


def ambiguous_titles(rows: DataFrame, title: str, work: str) -> DataFrame:
    """Titles that several works share."""
    return rows.groupBy(title).agg(F.countDistinct(work).alias("works")).filter("works > 1")


def cross_reuse(rows: DataFrame, source_key: str, identity: str) -> DataFrame:
    """Source works that are used for more than one identity."""
    return rows.groupBy(source_key).agg(F.countDistinct(identity).alias("identities")).filter("identities > 1")


def character_consensus(samples: DataFrame, group: str, text: str) -> DataFrame:
    """``group, consensus``: the majority character at each place of equally long samples, null without a majority everywhere."""
    samples = samples.select(group, text)
    sizes = samples.groupBy(group).agg(F.count("*").alias("n"), F.min(F.length(text)).alias("low"), F.max(F.length(text)).alias("high"))
    chars = samples.join(sizes.filter("low = high and low > 0"), group).select(group, "n", "low", F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "c"))
    votes = chars.groupBy(group, "pos", "c").agg(F.count("*").alias("v"), F.max("n").alias("n"), F.max("low").alias("len"))
    won = votes.filter(F.col("v") >= F.floor(F.col("n") / 2) + 1)
    joined = won.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("chars"), F.max("len").alias("len"))
    text_ = F.when(F.size("chars") == F.col("len"), F.array_join(F.transform("chars", lambda x: x["c"]), ""))
    return samples.select(group).distinct().join(joined.select(group, text_.alias("consensus")), group, "left")


def _path(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


# fixed values: paths that lead to no single work, and the kinds of places a name may end with
BARRED = ("/search", "/author/", "/authors/", "/login")
SUFFIXES = "省市县区州府郡镇乡村山寺亭楼阁台园"


def semantic_errors(packages: DataFrame, years: list[str], places: list[str], direct: dict[str, str], barred: tuple[str, ...] = BARRED, suffixes: str = SUFFIXES) -> DataFrame:
    """Adds ``errors``: the publication rules that a fact package breaks, stricter than its schema, as a sorted array of names.

    ``packages`` have ``evidence``, an array of ``struct<evidence_id, excerpt, supports, grade, url>``, ``context_facts``, an array of ``struct<text,
    evidence_ids>``, and the columns ``years`` and ``places``.  The rules:

    * ``date_visible``: every year stands in an excerpt of grade A or B that supports the date; an unknown year stands nowhere;
    * ``place_visible``: of some place its name, or a part of two characters or more between ``suffixes``, stands in such an excerpt on the place;
    * ``direct_page``: evidence on date or place comes from no page with a ``barred`` path;
    * ``page_shape``: if its host holds a key of ``direct``, path and query fit that pattern;
    * ``identity_grade``: evidence that supports nothing is graded C or D;
    * ``context_support``: every context fact names evidence on a life event or the historical context.
    """
    strong = lambda e: e["grade"].isin("A", "B")
    told = lambda e, what: F.coalesce(F.array_contains(e["supports"], F.lit(what)), F.lit(False))
    excerpts = lambda what: F.array_join(F.transform(F.filter("evidence", lambda e: strong(e) & told(e, what)), lambda e: F.coalesce(e["excerpt"], F.lit(""))), "\n")
    dates, found = excerpts("date"), excerpts("place")
    chronology = F.filter("evidence", lambda e: told(e, "date") | told(e, "place"))
    all_years = F.lit(True)
    for y in years:
        all_years &= F.coalesce(F.contains(dates, F.col(y).cast("string")), F.lit(False))

    def visible(name: str) -> Column:
        label = F.trim(F.col(name))
        parts = F.filter(F.split(label, f"[{suffixes}]+"), lambda p: F.length(p) >= 2)
        return F.coalesce((label != "") & (F.contains(found, label) | F.exists(parts, lambda p: F.contains(found, p))), F.lit(False))

    some_place = F.lit(False)
    for p in places:
        some_place |= visible(p)

    def shaped(e: Column) -> Column:
        host = F.lower(F.coalesce(F.try_parse_url(e["url"], F.lit("HOST")), F.lit("")))
        whole = F.concat_ws("?", _path(e["url"]), F.try_parse_url(e["url"], F.lit("QUERY")))
        ok = F.lit(True)
        for fragment, pattern in direct.items():
            ok &= ~F.contains(host, F.lit(fragment)) | whole.rlike(pattern)
        return ok

    supported = F.transform(F.filter("evidence", lambda e: told(e, "historical_context") | told(e, "life_event")), lambda e: e["evidence_id"])
    rules = {
        "context_support": ~F.exists("context_facts", lambda f: ~F.arrays_overlap(F.coalesce(f["evidence_ids"], F.array().cast("array<string>")), supported)),
        "date_visible": all_years,
        "direct_page": ~F.exists(chronology, lambda e: _path(e["url"]).rlike("|".join(f"\\Q{b}\\E" for b in barred))),
        "identity_grade": ~F.exists("evidence", lambda e: strong(e) & (F.coalesce(F.size(e["supports"]), F.lit(0)) < 1)),
        "page_shape": ~F.exists(chronology, lambda e: ~shaped(e)),
        "place_visible": some_place,
    }
    return package_errors(packages, rules)
