"""Reports over candidates: what each owner has, what of it can be reviewed, where it conflicts; rows split and put in order; sentences for facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import conflict_and_gap


def journey_report(roster: DataFrame, owner: str, reviewed: DataFrame, chronology: DataFrame, windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each owner of the roster: ``reviewed_nodes, chronology_rows, new_events, linked_works, unlinked_works, ambiguous_works, reviewable, conflicts,
    gaps, sources``.

    ``candidates(owner, id, kind, link, year, place, source)``: events and works, works with the state of their link.  Only linked works count for what can be reviewed, for
    conflicts with the ``windows(owner, win_start, win_end, win_place)`` and for gaps.  ``sources`` maps each source to its candidates.
    """
    works = candidates.filter("kind = 'work' AND link = 'linked'")
    sums = candidates.groupBy(owner).agg(
        F.count_if(F.col("kind") == "event").alias("new_events"),
        *[F.count_if((F.col("kind") == "work") & (F.col("link") == state)).alias(f"{state}_works") for state in ("linked", "unlinked", "ambiguous")],
    )
    by_source = candidates.groupBy(owner, "source").agg(F.count("*").alias("n")).groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))  # as many as there are sources
    met = conflict_and_gap(works, windows, owner, "id", "year", "place").select(owner, F.col("n_conflict").alias("conflicts"), F.col("n_gap").alias("gaps"))
    out = roster.select(owner).distinct()
    for side, name in ((reviewed, "reviewed_nodes"), (chronology, "chronology_rows")):
        out = out.join(side.groupBy(owner).agg(F.count("*").alias(name)), owner, "left")
    out = out.join(sums, owner, "left").join(met, owner, "left").join(by_source, owner, "left")
    numbers = ["reviewed_nodes", "chronology_rows", "new_events", "linked_works", "unlinked_works", "ambiguous_works", "conflicts", "gaps"]
    out = out.na.fill(0, numbers).withColumn("reviewable", F.col("new_events") + F.col("linked_works"))
    return out.select(owner, *numbers[:6], "reviewable", "conflicts", "gaps", F.coalesce("sources", F.create_map().cast("map<string,bigint>")).alias("sources"))


def split_in_order(rows: DataFrame, kind: str, wanted: str, ranks: dict[str, list[str]], then: list) -> tuple[DataFrame, DataFrame]:
    """The rows of one kind and all others, each in the order of ranked values (those that aren't listed last), then of further columns.

    The order doesn't depend on when a row was made, so results of tasks that ended in any order come out alike.
    """
    place = lambda c, values: F.coalesce(F.nullif(F.array_position(F.lit(values), F.col(c)), F.lit(0)), F.lit(len(values) + 1))
    order = [place(c, values) for c, values in ranks.items()] + list(then)
    is_wanted = F.coalesce(F.col(kind) == wanted, F.lit(False))
    return rows.filter(is_wanted).orderBy(*order), rows.filter(~is_wanted).orderBy(*order)


def fact_sentence(title: str, start: str, end: str, approximate: str, historical: str, province: str, modern: str, words: dict[str, str]) -> Column:
    """One sentence on when and where a work was made, null if any part is missing.

    ``words``: the patterns ``sentence`` (with {title}, {verb}, {years}, {historical}, {modern}), ``exact`` and ``about`` (the verbs) and ``between`` (what joins two years).
    A province that the modern name holds already isn't told twice.
    """
    years = F.when(F.col(start) == F.col(end), F.col(start).cast("string")).otherwise(F.concat(F.col(start).cast("string"), F.lit(words["between"]), F.col(end).cast("string")))
    place = F.when(F.contains(modern, F.col(province)), F.col(modern)).otherwise(F.concat(province, modern))
    parts = {"title": F.col(title), "verb": F.when(F.col(approximate), words["about"]).otherwise(words["exact"]), "years": years, "historical": F.col(historical), "modern": place}
    cells, rest = [], words["sentence"]
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        cells += [F.lit(before), parts[name]]
    return F.concat(*cells, F.lit(rest))


def usage_sums(calls: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """``by, calls`` and the sum of each of ``fields``; what isn't told counts 0."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])
