"""A registry of which identity a source knows each owner by: built from probes, kept over refreshes, added to by discoveries.

Statuses: ``identity_ambiguous`` and ``needs_disambiguation`` are fresh doubts and block everything older; ``audited_seed`` is an id that
was checked by hand; ``discovered`` one that was verified on the source; ``probe_unique`` the only fitting one a probe gave;
``name_query`` means that no id is known.  Ids that may no longer hold are listed as ``stale_ids``, never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKERS = ("identity_ambiguous", "needs_disambiguation")
ACTIVE = ("discovered", "audited_seed")
_IDS = "array<bigint>"


def _merged(*arrays: Column) -> Column:
    """Distinct known ids in order of their first place."""
    none = F.array().cast(_IDS)
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(a, none) for a in arrays])))


def _one(x: Column) -> Column:
    return F.array(x.cast("bigint"))


def probed(owners: DataFrame, probes: DataFrame, eras: dict[str, list[str]]) -> DataFrame:
    """``owner, era, status, author_id, candidate_ids, stale_ids, conflict_ids`` of ``owners(owner, era, seed_id)``.

    ``probes(owner, names, ids, source_eras, page_size, n_records)`` are parallel arrays of what a source answered; entries count that bear the owner's very
    name, a positive id, and an era that ``eras`` allows for the owner's.  Of several probes of an owner the last by ``probe_no`` counts.
    """
    last = probes.groupBy("owner").agg(F.max_by(F.struct("names", "ids", "source_eras", "page_size", "n_records"), "probe_no").alias("p"))
    table = F.create_map(*[v for e, ok in eras.items() for v in (F.lit(e), F.lit(ok))])
    entries = F.arrays_zip(F.col("p.names").alias("name"), F.col("p.ids").alias("id"), F.col("p.source_eras").alias("era"))
    fits = lambda e: (F.trim(e["name"]) == F.col("owner")) & (e["id"].try_cast("bigint") > 0) & F.array_contains(F.element_at(table, F.col("era")), e["era"])
    exact = F.array_distinct(F.transform(F.filter(F.coalesce(entries, F.array().cast("array<struct<name:string,id:string,era:string>>")), fits), lambda e: e["id"].try_cast("bigint")))
    rows = owners.join(last, "owner", "left").withColumn("_ids", F.coalesce(exact, F.array().cast(_IDS)))
    n, seed = F.size("_ids"), F.col("seed_id").cast("bigint")
    empty = (F.col("p.page_size") == 0) & (F.coalesce("p.n_records", F.lit(0)) == 0)
    blocked = F.when(n > 1, BLOCKERS[0]).when((n == 1) & F.coalesce(empty, F.lit(False)), BLOCKERS[1])
    only = F.when(n == 1, F.get("_ids", F.lit(0)))
    status = F.coalesce(blocked, F.when(seed.isNotNull(), "audited_seed"), F.when(n == 1, "probe_unique"), F.lit("name_query"))
    return rows.select(
        "owner", "era", status.alias("status"), F.when(blocked.isNotNull(), only).otherwise(F.coalesce(seed, only)).alias("author_id"), F.col("_ids").alias("candidate_ids"),
        F.when(blocked.isNotNull(), _merged(_one(seed))).otherwise(F.array().cast(_IDS)).alias("stale_ids"),
        F.when(seed.isNotNull() & (n > 0) & ~F.array_contains("_ids", seed), F.col("_ids")).otherwise(F.array().cast(_IDS)).alias("conflict_ids"),
        F.lit(False).alias("verified"), F.lit(None).cast("string").alias("verified_at"), F.lit(None).cast("bigint").alias("discovery_conflict"),
    )


def preserved(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """The ``fresh`` registry with what the ``old`` one knew and may still say; both as ``probed`` gives them.

    A verified old identity comes back where the fresh one knows none, or knows the same (a seed stays a seed).  An old identity that differs, isn't verified, or
    meets a fresh doubt is listed as stale; if it was verified and differs, it is the ``discovery_conflict`` too.  Old stale ids stay listed.
    """
    was = old.groupBy("owner").agg(F.max(F.struct("verified", "verified_at", "status", "author_id", "stale_ids", "discovery_conflict")).alias("o"))
    o = lambda c: F.col(f"o.{c}")
    active = F.coalesce(o("status").isin(*ACTIVE) & o("author_id").isNotNull(), F.lit(False))
    sure = active & F.coalesce(o("verified"), F.lit(False))
    rows = fresh.join(was, "owner", "left")
    blocked, none = F.col("status").isin(*BLOCKERS), F.col("status") == "name_query"
    same = active & ~blocked & ~none & F.coalesce(F.col("author_id") == o("author_id"), F.lit(False))
    other = active & ~blocked & ~none & F.coalesce(F.col("author_id") != o("author_id"), F.lit(False))
    back = sure & ((none & ~blocked) | same)
    gone = (active & blocked) | (active & none & ~sure) | other
    return rows.select(
        "owner", "era", F.when(back & ~(same & (F.col("status") == "audited_seed")), o("status")).otherwise(F.col("status")).alias("status"),
        F.when(back, o("author_id")).otherwise(F.col("author_id")).alias("author_id"), "candidate_ids",
        _merged(F.col("stale_ids"), o("stale_ids"), _one(o("discovery_conflict")), F.when(gone, _one(o("author_id")))).alias("stale_ids"), "conflict_ids",
        (F.col("verified") | back).alias("verified"), F.when(back, o("verified_at")).otherwise(F.col("verified_at")).alias("verified_at"),
        F.when(other & sure, o("author_id")).otherwise(F.col("discovery_conflict")).alias("discovery_conflict"),
    )


def discovered(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with ids that were verified on the source since, ``found(owner, n, author_id, verified_name, verified_era, verified_at)`` in the order ``n``.

    A discovery counts if it bears the owner's name, an era that isn't another one than the owner's, an id and a time.  Under a fresh doubt its id is only
    listed as stale.  An owner without an id takes the first one; the last discovery of the same id gives the time; the last one of another id is
    the ``discovery_conflict``.
    """
    fits = (F.col("author_id") > 0) & (F.coalesce("verified_at", F.lit("")) != "") & (F.col("verified_name") == F.col("owner"))
    eras = registry.select("owner", F.col("era").alias("_era"), F.col("author_id").alias("_held"))
    good = found.filter(fits).join(eras, "owner").filter((F.coalesce("_era", F.lit("")) == "") | (F.col("_era") == F.col("verified_era")))
    first = good.groupBy("owner").agg(F.min_by("author_id", "n").alias("_first"), F.array_sort(F.collect_set("author_id")).alias("_all"))  # the ids of one owner
    rows = good.join(first.select("owner", "_first"), "owner").withColumn("_own", F.coalesce("_held", "_first"))
    same = F.col("author_id") == F.col("_own")
    last = rows.groupBy("owner").agg(F.max_by(F.when(same, F.col("verified_at")), F.when(same, F.col("n"))).alias("_at"), F.max_by(F.when(~same, F.col("author_id")), F.when(~same, F.col("n"))).alias("_other"))
    whole = registry.join(first, "owner", "left").join(last, "owner", "left")
    blocked = F.col("status").isin(*BLOCKERS)
    taken = ~blocked & F.col("_at").isNotNull()
    return whole.select(
        "owner", "era", F.when(taken & (F.col("status") != "audited_seed"), "discovered").otherwise(F.col("status")).alias("status"),
        F.when(taken, F.coalesce("author_id", "_first")).otherwise(F.col("author_id")).alias("author_id"), "candidate_ids",
        _merged(F.col("stale_ids"), F.when(blocked, F.col("_all"))).alias("stale_ids"), "conflict_ids", (F.col("verified") | taken).alias("verified"),
        F.when(taken, F.col("_at")).otherwise(F.col("verified_at")).alias("verified_at"), F.when(~blocked & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("discovery_conflict")).alias("discovery_conflict"),
    )
