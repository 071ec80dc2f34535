"""From candidates to facts: places from journeys, coordinate and reference checks, authority matching, linking, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import table_of
from ..functions.geo import overlaps
from ..sources.scratch import stored
from .evidence import character_consensus
from .joins import band_join, cluster_diameter
from .linkage import overlap_years
from .order import in_order, parts_for
from .transitions import transitions

TOLERANCE = 1  # years, fixed value
CLUSTER_KM = 300.0  # fixed value
SHARED = 32  # owners of an alias up to which its pairs are joined one by one
BLOCK_OWNERS, BLOCK_RECORDS, BLOCKS = 1024, 64, 1024  # members of a block (a task holds the pairs of two at once), pairs of blocks of a task


def journey_places(works: DataFrame, events: DataFrame, key: str, work_id: str, year: str, event_year: str, place: str, lon: str, lat: str, tolerance: int = TOLERANCE, km: float = CLUSTER_KM) -> DataFrame:
    """``work_id, place, event_year, n_events``: where a work's author was in its year, if the events near that year agree on a place.

    The events of the same key within ``tolerance`` years must lie no further than ``km`` from one another; then the one nearest in
    time counts, ties by year and place.  Works of one key and year share their window, so each is looked at once.
    """
    windows = works.select(key, F.col(year).alias("_y")).distinct()
    near = band_join(windows, events.select(key, F.col(event_year).alias("_e"), F.col(place).alias("_p"), F.col(lon).alias("_lon"), F.col(lat).alias("_lat")), key, "_y", "_e", tolerance)
    near = near.withColumn("_w", F.struct(key, "_y"))
    wide = cluster_diameter(near, "_w", "_p", "_lon", "_lat").filter(F.col("diameter") <= km).select("_w")
    best = near.groupBy("_w").agg(F.min(F.struct(F.abs(F.col("_e") - F.col("_y")).alias("d"), F.col("_e").alias("e"), F.col("_p").alias("p"))).alias("b"), F.count("*").alias("n_events"))
    found = best.join(wide, "_w").select(F.col(f"_w.{key}").alias(key), F.col("_w._y").alias(year), F.col("b.p").alias(place), F.col("b.e").alias(event_year), "n_events")
    return works.select(work_id, key, year).join(found, [key, year]).select(work_id, place, event_year, "n_events")


def coordinate_reasons(candidates: DataFrame, addresses: DataFrame, key: str, name: str, own_name: str, lon: str, lat: str, years: tuple[str, str], own_years: tuple[str, str]) -> DataFrame:
    """Adds ``reason`` to candidates looked up by an address id: null if its coordinates are accepted, else why not, the first that holds.

    ``missing`` (no such address), ``name`` (another name), ``null`` (no coordinates), ``sentinel`` (0, 0), ``range`` (outside the
    globe or not finite), ``years`` (the closed year intervals don't meet; 0 and null are open ends).  Of several address rows with
    one id the smallest counts (by name, coordinates and years, nulls first), so a candidate stays one row.
    """
    addresses = addresses.groupBy(key).agg(F.min(F.struct(own_name, lon, lat, *own_years)).alias("_a")).select(key, "_a.*")
    side = addresses.select(F.col(key), F.lit(True).alias("_found"), F.col(own_name).alias("_name"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), *[F.nullif(F.col(y), F.lit(0)).alias(f"_y{k}") for k, y in enumerate(own_years)])
    both = candidates.join(side, key, "left")
    inside = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~F.isnan("lon") & ~F.isnan("lat")
    reason = (
        F.when(F.col("_found").isNull(), "missing")
        .when(~F.col(name).eqNullSafe(F.col("_name")), "name")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "null")
        .when((F.col("lon") == 0) & (F.col("lat") == 0), "sentinel")
        .when(~inside, "range")
        .when(~overlaps(years[0], years[1], "_y0", "_y1"), "years")
    )
    ok = reason.isNull()
    return both.select(*candidates.columns, F.when(ok, F.col("lon")).alias("lon"), F.when(ok, F.col("lat")).alias("lat"), reason.alias("reason"))


def reference_errors(child: DataFrame, parent: DataFrame, ref: str, key: str, owner: str, parent_owner: str) -> DataFrame:
    """``orphans, other_owner, repeated``: references without a row, to a row of another owner, and rows referred to more than once; one row.

    A parent id may stand several times: a reference is at fault only if none of its owners fits.  An owner that isn't known, on
    either side, is no fault.
    """
    keys = parent.groupBy(F.col(key).alias("_k")).agg(F.count_if(F.col(parent_owner).isNull()).alias("_unknown"))
    owners = parent.select(F.col(key).alias("_k2"), F.col(parent_owner).alias("_o")).filter("_o is not null").distinct()
    met = child.join(keys, F.col(ref) == F.col("_k"), "left").join(owners, (F.col(ref) == F.col("_k2")) & (F.col(owner) == F.col("_o")), "left")
    other = F.col("_k").isNotNull() & F.col(owner).isNotNull() & (F.col("_unknown") == 0) & F.col("_k2").isNull()
    flags = met.agg(F.count_if(F.col("_k").isNull()).alias("orphans"), F.count_if(other).alias("other_owner"))
    repeated = child.groupBy(ref).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return flags.crossJoin(repeated)  # one row each


# fixed values
NAME_SCORE = {"exact_name": 100, "traditional_alias": 90, "simplified_alias": 90, "mixed_alias": 85, "record_alias": 75, "names_field_alias": 70, "substring": 20}
ERA_SCORE = {"exact": 50, "compatible": 40, "unknown": 0, "mismatch": -60}
CREDIBLE = ("exact_name", "traditional_alias", "simplified_alias", "mixed_alias", "record_alias")


def name_method(local, source, to_traditional: dict[str, str] | None = None) -> Column:
    """How a source's name fits a local one: exactly, as its traditional or simplified form, in mixed script, or null."""
    a, b = F.trim(F.col(local) if isinstance(local, str) else local), F.trim(F.col(source) if isinstance(source, str) else source)
    table = to_traditional or {}
    simple, full = "".join(table), "".join(table.values())
    up, down = (lambda x: F.translate(x, simple, full)), (lambda x: F.translate(x, full, simple))
    return F.when(b == "", None).when(a == b, "exact_name").when(b == up(a), "traditional_alias").when(b == down(a), "simplified_alias").when(down(b) == down(a), "mixed_alias")


def era_kind(era, tokens, families: dict[str, list[str]], empty=("", "unknown")) -> Column:
    """``exact``, ``compatible`` (a token of the era's family), ``unknown`` (no token says anything) or ``mismatch``."""
    e, t = F.col(era), F.col(tokens)
    family = F.coalesce(F.element_at(table_of(families, "map<string,array<string>>"), e), F.array().cast("array<string>"))
    said = F.filter(t, lambda x: ~x.isin(*empty))
    return F.when(F.size(said) == 0, "unknown").when(F.array_contains(t, e), "exact").when(F.arrays_overlap(t, family), "compatible").otherwise("mismatch")


def date_score(birth: tuple[str, str], own_birth: tuple[str, str], death: tuple[str, str], own_death: tuple[str, str]) -> Column:
    """Birth and death compared apart: 0 if neither is known on both sides, -90 if a known one doesn't meet, else 40 and up to 20 years met."""
    known = lambda a, b: F.col(a[0]).isNotNull() & F.col(b[0]).isNotNull()
    part = lambda a, b: F.when(known(a, b), overlap_years(a[0], a[1], b[0], b[1]))
    b, d = part(birth, own_birth), part(death, own_death)
    apart = F.coalesce(b == 0, F.lit(False)) | F.coalesce(d == 0, F.lit(False))
    met = F.coalesce(b, F.lit(0)) + F.coalesce(d, F.lit(0))
    return F.when(b.isNull() & d.isNull(), 0).when(apart, -90).otherwise(40 + F.least(met, F.lit(20)))


def _lengths(names: DataFrame, name: str) -> list[int]:
    """The lengths that names have: a part of any other length can't be a name.  One row for each comes to the driver."""
    return sorted(r[0] for r in names.select(F.length(name)).distinct().collect() if r[0])


def _parts(text: str, lengths: list[int]) -> Column:
    """The distinct parts of a text that are as long as some name."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(F.array().cast("array<string>"), *[of(k) for k in lengths]))))


def authority_matches(local: DataFrame, records: DataFrame, local_id: str, record_id: str, families: dict[str, list[str]], shortest: int = 2) -> DataFrame:
    """``local_id, record, total, outcome``: the credible record with the best score, if it is alone there.

    ``local(id, name, era, birth_low, birth_high, death_low, death_high)`` and ``records(id, r_name, aliases, eras, born_low,
    born_high, died_low, died_high)``.  Score: name, era and dates.  Candidates meet by name, alias, or a part of the record's
    name, each an equality; only strong names without contradicting dates are credible.  ``outcome`` is ``matched``, ``ambiguous`` (several
    best ones, or none that is credible) or ``not_found``.  Rows that differ in nothing but their id are compared as one, so a common name
    costs as many pairs as it has different eras and dates, not as it has rows.
    """
    traits = [c for c in local.columns if c != local_id]
    kinds = local.select(F.struct(*traits).alias("_kind")).distinct().select("_kind", "_kind.*")
    # equal records are one class, with its least and greatest id: an id is alone at the top if both are the same
    rid = F.struct(F.col(record_id).alias("id"))
    classes = records.groupBy(*[c for c in records.columns if c != record_id]).agg(F.min(rid).alias("_low"), F.max(rid).alias("_high"))
    lengths = [k for k in _lengths(local, "name") if k >= shortest]
    parts = _parts("r_name", lengths)
    keys = F.array_distinct(F.concat(F.array("r_name"), F.coalesce("aliases", F.array().cast("array<string>")), parts))
    met = kinds.join(classes.withColumn("name", F.explode(keys)), "name")
    method = F.coalesce(name_method("name", "r_name"), F.when(F.array_contains("aliases", F.col("name")), "record_alias"), F.when(F.contains("r_name", F.col("name")), "substring"))
    scored = met.withColumn("_m", method).filter("_m is not null").withColumn("_d", date_score(("born_low", "born_high"), ("birth_low", "birth_high"), ("died_low", "died_high"), ("death_low", "death_high")))
    total = F.element_at(table_of(NAME_SCORE, "map<string,int>"), F.col("_m")) + F.element_at(table_of(ERA_SCORE, "map<string,int>"), era_kind("era", "eras", families)) + F.col("_d")
    scored = scored.select("_kind", "_low", "_high", total.alias("_t"), (F.col("_m").isin(*CREDIBLE) & (F.col("_d") >= 0)).alias("_ok"))
    top = lambda t: F.max(F.when(F.col("_ok"), F.struct(t, "_low", "_high")))
    tops = scored.groupBy("_kind", "_t").agg(F.min(F.when(F.col("_ok"), F.col("_low"))).alias("_low"), F.max(F.when(F.col("_ok"), F.col("_high"))).alias("_high"), F.bool_or("_ok").alias("_ok"))
    best = tops.groupBy("_kind").agg(top("_t").alias("_b"))
    own = local.select(local_id, F.struct(*traits).alias("_kind")).join(best, "_kind")
    found = own.groupBy(local_id, F.col("_b._t").alias("_t")).agg(F.min("_b._low").alias("_low"), F.max("_b._high").alias("_high")).groupBy(local_id).agg(F.lit(True).alias("_any"), F.max(F.when(F.col("_low").isNotNull(), F.struct("_t", "_low", "_high"))).alias("b"))
    out = local.select(local_id).join(found, local_id, "left")
    alone = F.col("b._low") == F.col("b._high")
    outcome = F.when(F.col("_any").isNull(), "not_found").when(alone, "matched").otherwise("ambiguous")
    return out.select(local_id, F.when(alone, F.col("b._low.id")).alias("record"), F.col("b._t").alias("total"), outcome.alias("outcome"))


def catalog_matches(roster: DataFrame, records: DataFrame, owner: str, record: str, joined: str | None = None) -> DataFrame:
    """``owner, record, status, methods``: which catalog records name an owner, and how surely.

    ``roster(owner, era, aliases)`` and ``records(record, eras, header, responsible, people, title)``: arrays of names, ``people`` of
    ``struct<name, era>``.  A record of other eras is no match.  An alias in the header, among the responsible or among the people (of no other
    era) is a strong method and makes a match; one inside the title of a record of known era alone leaves it ambiguous.  A match by
    an alias that several owners share is ambiguous too.  Names meet by equality; of titles the parts are compared.

    Aliases of at most ``SHARED`` owners are joined pair by pair.  Owners with the same commoner aliases are one kind, and so are records
    with the same entries of them: kinds are compared, and a pair of kinds is spelt out from blocks of its owners and records, so the
    pairs of a common alias, whose number grows with the square of the tables, are neither shuffled nor grouped.  ``joined`` puts the methods
    together as one text, once for a pair of kinds.
    """
    names = roster.select(owner, "era", F.explode(F.array_distinct("aliases")).alias("alias")).filter("alias <> ''")
    shared = names.groupBy("alias").agg(F.countDistinct(owner).alias("_owners"))
    known_names = names.join(shared, "alias")
    pieces = _parts("title", _lengths(names, "alias"))
    entry = lambda array, method: F.transform(array, lambda x: F.struct(x.alias("alias"), F.lit(None).cast("string").alias("of"), F.lit(method).alias("method")))
    people = F.transform("people", lambda x: F.struct(x["name"].alias("alias"), F.nullif(x["era"], F.lit("")).alias("of"), F.lit("person").alias("method")))
    none = F.array().cast("array<struct<alias:string,of:string,method:string>>")
    known = F.size("eras") > 0
    told = F.concat(*[F.coalesce(a, none) for a in (entry("header", "header"), entry("responsible", "responsible"), people, F.when(known, entry(pieces, "title")))])
    cells = records.select(record, "eras", F.explode(F.array_distinct(told)).alias("c")).select(record, "eras", "c.*")
    fits = ((F.size("eras") == 0) | F.array_contains("eras", F.col("era"))) & (F.col("of").isNull() | (F.col("of") == F.col("era")))
    strong = F.col("method") != "title"
    sums = F.collect_set("method").alias("_methods"), F.bool_or(strong).alias("_strong"), F.max(F.when(strong, F.col("_owners"))).alias("_shared")
    methods = F.array_sort("_methods") if joined is None else F.array_join(F.array_sort("_methods"), joined)
    told_as = F.when(F.col("_strong") & (F.col("_shared") == 1), "matched").otherwise("ambiguous").alias("status"), methods.alias("methods")
    few = cells.join(known_names.filter(F.col("_owners") <= SHARED), "alias").filter(fits).groupBy(owner, record).agg(*sums)
    common = shared.filter(F.col("_owners") > SHARED)
    if not common.take(1):
        return few.select(owner, record, *told_as)
    # what owners and records have of common aliases: a few entries each, the same for many of them
    own = known_names.filter(F.col("_owners") > SHARED).groupBy(F.col(owner).alias("_o")).agg(F.sort_array(F.collect_set(F.struct("era", "alias", "_owners"))).alias("_own"))
    rec = cells.join(common.select("alias"), "alias", "left_semi").groupBy(F.col(record).alias("_r")).agg(F.sort_array(F.collect_set(F.struct("eras", "alias", "of", "method"))).alias("_rec"))
    spread = lambda df, kind: df.select(kind).distinct().select(kind, F.explode(kind).alias("_e")).select(kind, "_e.*")
    kinds = stored(spread(own, "_own").join(spread(rec, "_rec"), "alias").filter(fits).groupBy("_own", "_rec").agg(*sums), "kinds")
    # a pair found in both ways is told with the few, and the record notes that owner
    theirs = kinds.select("_own", "_rec", *[F.col(c).alias(f"_k{c}") for c in ("_methods", "_strong", "_shared")])
    both = few.join(own, F.col(owner).eqNullSafe(F.col("_o")), "left").join(rec, F.col(record).eqNullSafe(F.col("_r")), "left").join(theirs, ["_own", "_rec"], "left")
    every = F.array_union("_methods", F.coalesce("_k_methods", F.array().cast("array<string>")))
    few = stored(both.select(owner, record, every.alias("_methods"), (F.col("_strong") | F.coalesce("_k_strong", F.lit(False))).alias("_strong"), F.greatest("_shared", "_k_shared").alias("_shared"), F.col("_k_strong").isNotNull().alias("_both")), "few")
    told_there = few.filter("_both").groupBy(F.col(record).alias("_r2")).agg(F.collect_list(F.struct(owner)).alias("_not"))  # owners of rare aliases of one record
    rec = rec.join(told_there, F.col("_r").eqNullSafe(F.col("_r2")), "left").select("_rec", F.struct("_r", "_not").alias("_item"))
    owners = _blocks(own.select("_own", F.struct("_o").alias("_item")), "_own", BLOCK_OWNERS).withColumnRenamed("_items", "_owners_of")
    blocks = kinds.select("_own", "_rec", *told_as).join(owners, "_own").join(_blocks(rec, "_rec", BLOCK_RECORDS), "_rec").select("_owners_of", "_items", "status", "methods")
    pairs = blocks.repartition(parts_for(blocks, BLOCKS)).withColumn("_item", F.explode("_items")).drop("_items").withColumn("_o", F.explode("_owners_of"))
    pairs = pairs.filter(F.col("_item._not").isNull() | ~F.array_contains("_item._not", F.struct(F.col("_o._o").alias(owner))))
    whole = pairs.select(F.col("_o._o").alias(owner), F.col("_item._r").alias(record), "status", "methods")
    return few.select(owner, record, *told_as).unionByName(whole)


def _blocks(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """``kind, _items``: the items of each kind in lists of at most ``size``, however many it has."""
    whole = in_order(rows, [kind, "_item"], parts_for(rows))
    return whole.groupBy(kind, "_part", F.floor(F.col("_seq") / size).alias("_block")).agg(F.collect_list("_item").alias("_items")).select(kind, "_items")


def link_works(works: DataFrame, poems: DataFrame, owner: str, title: str, source_id: str, author: str, grade: str, poem_id: str) -> DataFrame:
    """Adds ``poem, linked, grade`` to works: linked if the source's title is its own there, one local poem of the owner has it, and an author is named.

    A work without an author is of grade C at best.  ``title`` is a normalised title on both sides.
    """
    several = works.groupBy(owner, title).agg(F.countDistinct(source_id).alias("_works"))
    local = poems.groupBy(owner, title).agg(F.count("*").alias("_n"), F.min(poem_id).alias("_poem"))
    both = works.join(several, [owner, title]).join(local, [owner, title], "left")
    named = F.coalesce(F.trim(F.col(author)), F.lit("")) != ""
    linked = (F.col("_works") == 1) & (F.coalesce("_n", F.lit(0)) == 1) & named
    kept = [c for c in works.columns if c != grade]
    return both.select(*kept, F.when(named, F.col(grade)).otherwise("C").alias(grade), F.when(linked, F.col("_poem")).alias("poem"), linked.alias("linked"))


def resolve_identities(rows: DataFrame, identities: DataFrame, key: list[str], identity: str, rebound: DataFrame | None = None) -> DataFrame:
    """Adds ``identity`` and ``n_identities``: the one identity of a row's key, null if there is none or more than one.

    ``rebound(key, identity)``, a short list of settled cases, comes first.
    """
    own = identities.groupBy(*key).agg(F.countDistinct(identity).alias("n_identities"), F.min(identity).alias("_i"))
    out = rows.join(own, key, "left").withColumn("n_identities", F.coalesce("n_identities", F.lit(0)))
    one = F.when(F.col("n_identities") == 1, F.col("_i"))
    if rebound is not None:
        out = out.join(rebound.select(*key, F.col(identity).alias("_settled")), key, "left")
        one = F.coalesce("_settled", one)
    return out.select(*rows.columns, one.alias(identity), "n_identities")


def source_match_score(ids: tuple[str, str], owners: tuple[str, str], titles: tuple[str, str], first_lines: tuple[str, str]) -> Column:
    """1.0 for the same id and owner, 0.95 for the same title, 0.90 if one title holds the other and the first lines are equal, else 0."""
    c = lambda x: F.coalesce(F.trim(F.col(x)), F.lit(""))
    same = lambda p: c(p[0]) == c(p[1])
    given = lambda *xs: (sum((F.when(c(x) != "", 0).otherwise(1) for x in xs), F.lit(0)) == 0)
    holds = F.contains(c(titles[0]), c(titles[1])) | F.contains(c(titles[1]), c(titles[0]))
    return (
        F.when(given(ids[0], ids[1], owners[0]) & same(ids) & same(owners), 1.0)
        .when(same(owners) & given(titles[0]) & same(titles), 0.95)
        .when(same(owners) & given(*titles) & holds & given(first_lines[0]) & same(first_lines), 0.90)
        .otherwise(0.0)
    )


def status_errors(status: DataFrame, packages: DataFrame, owner: str, state: str, identity: list[str], reason: str) -> DataFrame:
    """``owner, errors``: what doesn't fit between a batch's status rows and its packages, only owners with errors.

    A verified owner needs exactly one package of the same identity, one on hold none; every package needs a status row;
    every row a reason and a known state.
    """
    made = packages.groupBy(owner).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_{c}") for c in identity])
    both = status.withColumn("_row", F.lit(True)).join(made, owner, "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    same = F.lit(True)
    for c in identity:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    verified, row = F.col(state) == "verified", F.col("_row").isNotNull()
    rules = {
        "unassigned": ~row,
        "state": row & ~F.coalesce(F.col(state).isin("verified", "hold"), F.lit(False)),
        "reason": row & (F.coalesce(F.trim(reason), F.lit("")) == ""),
        "not_one_package": row & verified & (F.col("_n") != 1),
        "other_identity": row & verified & (F.col("_n") == 1) & ~same,
        "package_on_hold": row & (F.col(state) == "hold") & (F.col("_n") > 0),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return both.select(owner, errors.alias("errors")).filter(F.size("errors") > 0)


def release_summary(packages: DataFrame, roster: DataFrame, owner: str, verdict: str, family: str) -> DataFrame:
    """``kind, name, n``: packages by verdict, by source family and by owner, and the owners of the roster without any."""
    count = lambda kind, c: packages.groupBy(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"))
    missing = roster.join(packages.select(owner), owner, "left_anti").select(F.lit("missing").alias("kind"), F.col(owner).cast("string").alias("name"), F.lit(0).cast("bigint").alias("n"))
    return count("verdict", verdict).unionByName(count("family", family)).unionByName(count("owner", owner)).unionByName(missing)


def strongest_source(sources: DataFrame, key: str, grade: str, order: list[str], bases: dict[str, float]) -> DataFrame:
    """Of each key the source with the highest base of its grade, ties to the first in order."""
    base = F.coalesce(F.element_at(table_of(bases, "map<string,double>"), F.col(grade)), F.lit(0.0))
    others = [c for c in sources.columns if c != key]
    best = sources.groupBy(key).agg(F.min(F.struct((-base).alias("_b"), *order, *[c for c in others if c not in order])).alias("_s"))
    return best.select(key, *[F.col(f"_s.{c}").alias(c) for c in others])


def settled_versions(stored: DataFrame, samples: DataFrame, key: str, body: str, number: str) -> DataFrame:
    """``key, body, mode``: which text of a group of stored versions holds, given fresh samples in order.

    The first sample if it is stored (``matched_stored_version``), else the first text that was sampled twice
    (``repeated_fresh_version``), else the majority character by character (``per_character_consensus``); null and ``unresolved`` if none.
    """
    first = samples.groupBy(key).agg(F.min_by(body, number).alias("_first"))
    known = first.join(stored.select(key, F.col(body).alias("_first")).distinct(), [key, "_first"], "left_semi").select(key, F.col("_first").alias("_stored"))
    twice = samples.groupBy(key, body).agg(F.get(F.array_sort(F.collect_list(number)), F.lit(1)).alias("_second")).filter("_second is not null")  # a few samples of a group
    fresh = twice.groupBy(key).agg(F.min_by(body, "_second").alias("_fresh"))
    voted = character_consensus(samples, key, body)
    every = first.select(key).join(known, key, "left").join(fresh, key, "left").join(voted, key, "left")
    mode = F.when(F.col("_stored").isNotNull(), "matched_stored_version").when(F.col("_fresh").isNotNull(), "repeated_fresh_version").when(F.col("consensus").isNotNull(), "per_character_consensus").otherwise("unresolved")
    return every.select(key, F.coalesce("_stored", "_fresh", "consensus").alias(body), mode.alias("mode"))


def owner_summary(parts: dict[str, tuple[DataFrame, dict[str, Column]]], owner: str) -> DataFrame:
    """Aggregates of several tables side by side, a row for each owner that any of them has; counts are 0 where a table has none."""
    out = None
    for name, (df, aggregates) in parts.items():
        own = df.groupBy(owner).agg(*[a.alias(f"{name}_{k}") for k, a in aggregates.items()])
        out = own if out is None else out.join(own, owner, "full_outer")
    return out.na.fill(0)


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n``: how often each value of several columns occurs, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def same_place_works(mentions: DataFrame, key: str, work: str, order: str, rank: list, cap: int = 30, k: int = 3) -> DataFrame:
    """For each (work, key) the ``k`` best other works of the key, of the first ``cap`` in corpus order; no pairs beyond the cap are made.

    ``mentions(key, work, order, ...)`` has a row for each work of a key.  Of each key the first ``cap + 1`` works are kept, so each
    work still finds ``cap`` others.
    """
    from .stylometry import first_k

    ranks = [f"_r{i}" for i in range(len(rank))]
    pool = first_k(mentions.select(key, F.col(work).alias("_other"), F.col(order).alias("_o"), *[F.col(c).alias(r) for c, r in zip(rank, ranks)]), key, ["_o"], cap + 1, "_place")
    listed = pool.filter("_other is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_place", *ranks, "_other"))).alias("_pool"))  # cap + 1 works of a key at most
    ranked = lambda works: F.array_sort(F.transform(works, lambda x: F.struct(*[x[r].alias(r) for r in ranks], x["_other"].alias("_other"))))
    # works of the pool choose from the others in it, all works behind it from the first ones: both are ranked once for each key
    best = listed.select(key, F.transform("_pool", lambda x: x["_other"]).alias("_works"), F.slice(ranked(F.col("_pool")), 1, k + 1).alias("_near"), F.slice(ranked(F.slice("_pool", 1, cap)), 1, k).alias("_rest"))
    inside = F.array_contains("_works", F.col(work))
    own = F.when(inside, F.slice(F.filter("_near", lambda x: x["_other"] != F.col(work)), 1, k)).when(F.col(work).isNotNull(), F.col("_rest"))
    picks = mentions.select(key, work).join(best, key).select(key, work, F.posexplode(own).alias("_n", "_b"))
    return picks.select(key, work, F.col("_b._other").alias("other"), (F.col("_n") + 1).alias("place"))


def resume_pages(wanted: DataFrame, done: DataFrame, scope: list[str], page: str, status: str) -> DataFrame:
    """The pages still to be collected: those after the last of a scope's unbroken run of completed pages from 1."""
    ok = done.filter(F.col(status) == "completed").select(*scope, page).distinct()
    whole = ok.groupBy(*scope).agg(F.count("*").alias("n"), F.max(page).alias("top"), F.array_sort(F.collect_list(page)).alias("pages"))  # pages of a scope
    run = F.aggregate("pages", F.lit(0).cast("bigint"), lambda acc, p: F.when(p == acc + 1, p.cast("bigint")).otherwise(acc))
    return wanted.join(whole.select(*scope, run.alias("_done")), scope, "left").filter(F.col(page) > F.coalesce("_done", F.lit(0))).drop("_done")


def compare_terms(rates: DataFrame, word: str, left: str, right: str, requested: list[str] | None = None, k: int = 8, chapters: DataFrame | None = None, chapter: str | None = None) -> DataFrame:
    """``word, left, right, delta, higher_in, place``: the requested words in their order, or the ``k`` that differ most; unknown words are an error.

    Of the requested words the first ``k`` are answered, which is the feature's own limit; the others are only checked.  With a ``chapter``, which must be one
    of ``chapters(chapter, word, rank)``, the word's ``chapter_rank`` there is told too, null if it has none.
    """
    delta = F.round(F.col(right) - F.col(left), 6)
    every = rates.select(word, left, right, delta.alias("delta"), F.when(delta > 0, right).when(delta < 0, left).otherwise("equal").alias("higher_in"))
    if chapter is not None:
        own = chapters.filter(F.col("chapter") == chapter)
        if not own.take(1):
            raise ValueError(f"unknown chapter: {chapter}")
        every = every.join(own.groupBy(word).agg(F.min("rank").alias("chapter_rank")), word, "left")
    if requested is None:
        top = every.orderBy(F.desc(F.abs("delta")), word).limit(k)
        return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.abs("delta")), word)))  # k rows
    unknown = set(requested) - {r[0] for r in every.filter(F.col(word).isin(requested)).select(word).collect()}  # no more than were asked for
    if unknown:
        raise ValueError(f"unknown words: {sorted(unknown)}")
    wanted = list(dict.fromkeys(requested))[:k]
    return every.filter(F.col(word).isin(wanted)).withColumn("place", F.array_position(F.lit(wanted), F.col(word)).cast("int"))


def owner_catalog(owners: DataFrame, routes: DataFrame, owner: str, route: str) -> DataFrame:
    """Owners with ``n_routes`` and ``available``."""
    n = routes.groupBy(owner).agg(F.countDistinct(route).alias("n_routes"))
    return owners.join(n, owner, "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0))).withColumn("available", F.col("n_routes") > 0)


def playback_index(scenes: DataFrame, route: str, order: list, scene: str) -> DataFrame:
    """``route, scene, step, is_last``: the scenes of a route in order, from 1."""
    by = W.partitionBy(route)
    step = F.row_number().over(by.orderBy(*order))
    return scenes.select(route, scene, step.alias("step"), (step == F.count("*").over(by)).alias("is_last"))


def sample_lines(cells: DataFrame, lines: DataFrame, item: str, label: str, order: str, text: str, low: int = 4, high: int = 30, k: int = 3) -> DataFrame:
    """``item, label, order, text, place``: up to ``k`` lines for each cell, of each document the first of fitting length that holds the item.

    ``cells(item, label)`` and ``lines(item, label, order, text, line_no)``, the lines in which the item was met.
    """
    from .stylometry import first_k

    fit = lines.filter(F.length(text).between(low, high)).join(cells.select(item, label), [item, label], "left_semi")
    first = fit.groupBy(item, label, order).agg(F.min_by(text, "line_no").alias(text))
    return first_k(first, [item, label], [order], k)


def composed_id(parts: list, digest: bool = True) -> Column:
    """An id over parts in order, nulls as empty and kept apart from their neighbours; long texts count by their own digest."""
    cells = [F.sha2(F.coalesce(F.col(p).cast("string"), F.lit("")), 256) if digest else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


def ranked_order(rows: DataFrame, column: str, ranks: list[str], then: list) -> DataFrame:
    """``rows`` in the order of a list of values, values that aren't listed last, then by further columns."""
    place = F.array_position(F.lit(ranks), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(F.lit(len(ranks) + 1)), column, *then)


def normalised_evidence(candidates: DataFrame, key: str, order: list, defaults: dict[str, str]) -> DataFrame:
    """Trimmed texts, empty ones replaced by their defaults, and of rows with one key the first in order."""
    clean = [F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in candidates.columns]
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return candidates.withColumn("_n", place).filter("_n = 1").select(*clean)


def apply_reviews(records: DataFrame, reviews: DataFrame, key: str, state: str, moves: dict[str, list[str]], note: str, order: list[str] | None = None) -> DataFrame:
    """Adds to records the reviewed ``state`` and ``note`` where the move from the old state is allowed, and ``refused`` where a review isn't.

    ``moves`` lists the states that may follow each.  Several reviews of a record are applied one after another in ``order`` (by state and note if
    none is given); the note is that of the last review that moved the record and has one, else the old one.  A review
    of an unknown record is left out.  A record stays one row.
    """
    order = order or [state, note]
    asked = reviews.withColumn("_order", F.struct(*order)).select(key, F.col(state).alias("_asked"), F.col(note).alias("_note"), "_order")
    history = transitions(records.select(key, state), asked, key, state, "_asked", ["_order"], moves)
    moved = F.col("refused").isNull()
    said = F.when(moved, F.nullif(F.trim("_note"), F.lit("")))
    last = history.groupBy(key).agg(
        F.max_by(F.when(moved, F.col("after")), F.when(moved, F.col("_order"))).alias("_state"), F.max_by(said, F.when(said.isNotNull(), F.col("_order"))).alias("_said"), F.max(F.col("refused").isNotNull()).alias("_refused")
    )
    kept = [c for c in records.columns if c not in (state, note)]
    both = records.join(last, key, "left")
    return both.select(*kept, F.coalesce("_state", state).alias(state), F.coalesce("_said", note).alias(note), F.coalesce("_refused", F.lit(False)).alias("refused"))


def terrain(hits: DataFrame, period: str, sentiment: str, scale: str) -> DataFrame:
    """``period, n, sentiment, scale``: the mean sentiment and scale of a period's imagery."""
    return hits.groupBy(period).agg(F.count("*").alias("n"), F.round(F.avg(sentiment), 6).alias("sentiment"), F.round(F.avg(scale), 6).alias("scale"))


def route_legs(nodes: DataFrame, route: str, order: str, node: str, precise: Column, chosen: DataFrame | None = None) -> DataFrame:
    """``route, from_id, to_id, leg``: legs between the nodes of a route that are precise enough, of the chosen scenes only if they are given."""
    fit = nodes.filter(precise)
    fit = fit if chosen is None else fit.join(chosen.select(route, node), [route, node], "left_semi")
    by = W.partitionBy(route).orderBy(order, node)
    legs = fit.select(route, order, node).repartition(parts_for(nodes.select(route)), route).select(route, F.col(node).alias("from_id"), F.lead(node).over(by).alias("to_id"), F.row_number().over(by).alias("leg"))
    return legs.filter("to_id is not null")


def assembled_routes(nodes: DataFrame, legs: DataFrame, segments: DataFrame, route: str, node: str, transport: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The legs of routes told in full, and the counts of each route.

    ``segments(route, from_id, to_id, note)`` are documented ways between two nodes, in either direction; of several on one leg the forward one counts, then the first by
    note.  Legs get its ``note``, ``direction`` (``forward``, ``reversed``, or null without a segment), and ``mode`` and ``basis``: the label of
    the first pattern of ``transport`` that the note fits, and the words that fit it.  Segments between other nodes are left out.
    Counts are ``route, n_nodes, n_legs, n_documented, n_by_mode`` (a map).
    """
    ways = segments.select(route, "from_id", "to_id", "note", F.lit("forward").alias("direction")).unionByName(segments.select(route, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "note", F.lit("reversed").alias("direction")))
    leg, parts = [route, "from_id", "to_id"], parts_for(nodes.select(route))  # what a task sorts stays the same whatever the number of routes
    best = ways.repartition(parts, *leg).groupBy(*leg).agg(F.min(F.struct("direction", "note")).alias("_w"))
    told = legs.repartition(parts, *leg).join(best, leg, "left").withColumn("note", F.col("_w.note")).withColumn("direction", F.col("_w.direction")).drop("_w")
    mode = basis = None
    for label, pattern in transport:
        fits = F.col("note").rlike(pattern)
        word = F.regexp_extract("note", f"({pattern})", 1)
        mode, basis = (F.when(fits, label), F.when(fits, word)) if mode is None else (mode.when(fits, label), basis.when(fits, word))
    told = told.withColumn("mode", mode.otherwise(F.when(F.col("direction").isNotNull(), "unknown"))).withColumn("basis", basis)
    by_mode = told.groupBy(route, "mode").agg(F.count("*").alias("n"), F.count("direction").alias("d")).groupBy(route).agg(
        F.sum("n").alias("n_legs"), F.sum("d").alias("n_documented"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("mode").isNotNull(), F.struct("mode", "n"))))).alias("n_by_mode")
    )  # a row for each mode at most
    counts = nodes.select(route, node).repartition(parts, route).groupBy(route).agg(F.countDistinct(node).alias("n_nodes")).join(by_mode, route, "left").na.fill(0, ["n_legs", "n_documented"])
    return told, counts.withColumn("n_by_mode", F.coalesce("n_by_mode", F.create_map().cast("map<string,bigint>")))


def near_length_decoys(items: DataFrame, group: str, item: str, size: str, seed: str, k: int = 3) -> DataFrame:
    """``item, decoy, place``: for each item the ``k`` others of its group and length class that a hash puts behind it, wrapping round.

    The items of a class stand in hash order; an item's decoys are the ones that follow, found by their places, so no pairs are made.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    by = W.partitionBy(group, size)
    placed = items.select(group, size, item, (F.row_number().over(by.orderBy(h, item)) - 1).alias("_p"), F.count("*").over(by).alias("_c"))
    wanted = placed.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter("place < _c").withColumn("_q", F.pmod(F.col("_p") + F.col("place"), F.col("_c")))
    other = placed.select(group, size, F.col(item).alias("decoy"), F.col("_p").alias("_q"))
    return wanted.join(other, [group, size, "_q"]).select(item, "decoy", "place")
