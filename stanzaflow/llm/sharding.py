"""Sharding by balanced label propagation.

Documents are linked when they share a group (by default: equal texts).  Linked documents start in
a shard hashed from their id.  Links joined with labels tell how many members of a group each shard holds: the group's votes,
counted by group and shard, so no pairs are made.  In each round every group that waits asks to move to the shard that holds most
of its members among those with room for the whole group, or to one with room that a hash names if none of those holds any.  A shard
that is asked for more than its room takes groups in order of a hash as far as they fit; groups that were refused don't hold room
anywhere and ask again in the next round.  Groups that are large for a shard go first, in classes whose sizes halve.  A
group is spread only if no shard has room for it, over as few shards as the room left allows, those that hold most of its members
before others of the same room.  Documents without links fill what is left of the quotas.

A round is one pass over the waiting groups and two sums by shard.  A class ends when each of its groups was taken or fits
nowhere, and of the latter there are fewer than shards, because together they are smaller than the room left.

The law kept is ``rows``: shard counts differ by one at most.  The exact shards come from one range sort
of slim rows and the sums of its partitions; slots follow a hash within the shard, so the copies of a text don't stand
one behind another, and come from a second sort of that kind.  ``assign_shards`` doesn't move texts.

To the driver come only sums by shard and bucket, groups that fit nowhere (fewer than shards in a class), and the row counts of the
partitions.

Defined cases: a null text counts as empty, and all empty texts are one group; a null doc_id is an id like others;
repeated rows are kept and take a slot each; ties between shards are broken by a hash of group and shard; more shards
than rows leave shards empty; the length of a text isn't limited; an empty table gives an empty result; extra
columns are not read by ``assign_shards`` and kept as they are by ``shard_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, cut, unused, without

SHARDS = 40
LARGE = 16  # groups of a quota's 16th part or more go in classes of their own, before all others
BUCKETS = 1024  # of the hash by which a shard that is asked for too much accepts groups
ADDED_BYTES = 16


def _pick(values, index):
    """The entry of a short list of numbers at an index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def describe(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id, size, text_crc32, grp`` of ``docs(doc_id, text)``, and other columns; equal texts have equal ``grp``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ADDED_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("grp"),
        *others,
    )


def _spread(votes: dict[int, int], size: int, room: list[int]) -> list[tuple[int, int]]:
    """``(shard, rows)`` pieces of a group that fits nowhere: whole rooms, largest first, and what is left where it fits best."""
    pieces = []
    while size:
        fits = [t for t, r in enumerate(room) if r >= size]
        held = {t: votes.get(t, 0) for t in range(len(room))}
        t = min(fits, key=lambda t: (room[t], -held[t], t)) if fits else max(range(len(room)), key=lambda t: (room[t], held[t], -t))
        rows = min(size, room[t])
        pieces.append((t, rows))
        room[t] -= rows
        size -= rows
    return pieces


def _round(waiting: DataFrame, room: list[int], r: int) -> DataFrame:
    """Adds ``target``, null if no shard has room for the group, and ``turn``, a number from 0 to 1, to ``waiting(grp, size, votes)``."""
    rooms = F.array(*[F.struct(F.lit(t).alias("shard"), F.lit(x).cast("bigint").alias("room")) for t, x in enumerate(room)])
    fits = F.transform(F.filter(rooms, lambda x: x["room"] >= F.col("size")), lambda x: x["shard"])
    voted = F.filter("votes", lambda v: F.array_contains("_fits", v["shard"]))
    most = F.array_max(F.transform(voted, lambda v: F.struct(v["n"], F.xxhash64("grp", v["shard"]), v["shard"].alias("shard"))))["shard"]
    other = F.get("_fits", F.pmod(F.xxhash64("grp", F.lit(r)), F.greatest(F.size("_fits"), F.lit(1))).cast("int"))
    turn = F.pmod(F.xxhash64("grp", F.lit(r), F.lit("accept")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return waiting.withColumn("_fits", fits).withColumn("target", F.coalesce(most, other)).withColumn("turn", turn).drop("_fits")


def _accepted(asked: DataFrame, room: list[int]) -> F.Column:
    """Which of the groups that ask are taken; ``room`` is used up.

    A shard that is asked for too much lets in the groups whose turns lie before a border: about the part of them that fits is cut into
    ``BUCKETS`` by turn, and buckets are taken until one doesn't fit.
    """
    wanted = {x["target"]: x["n"] for x in asked.groupBy("target").agg(F.sum("size").alias("n")).collect()}
    share = [min(1.0, 1.25 * room[t] / wanted[t]) if wanted.get(t, 0) > room[t] else 1.0 for t in range(len(room))]
    bucket = F.floor(F.col("turn") / _pick(share, F.col("target")) * BUCKETS)
    crowded = [t for t in range(len(room)) if wanted.get(t, 0) > room[t]]
    upto = [BUCKETS + 1.0 if t in wanted else 0.0 for t in range(len(room))]  # the first bucket that each shard refuses
    sums: dict[int, list] = {t: [] for t in crowded}
    if crowded:
        near = asked.filter(F.col("target").isin(crowded)).select("target", bucket.alias("bucket"), "size").filter(F.col("bucket") < BUCKETS)
        for x in near.groupBy("target", "bucket").agg(F.sum("size").alias("n")).collect():
            sums[x["target"]].append((x["bucket"], x["n"]))
    for t in range(len(room)):
        if t not in sums:
            room[t] -= wanted.get(t, 0)
            continue
        upto[t] = float(BUCKETS)
        for b, n in sorted(sums[t]):
            if n > room[t]:
                upto[t] = float(b)
                break
            room[t] -= n
    return F.coalesce(bucket < _pick(upto, F.col("target")), F.lit(False))


def propagate(held: DataFrame, quotas: list[int]) -> tuple[DataFrame, DataFrame, dict[str, list[tuple[int, int]]]]:
    """The places of the groups of ``held(grp, shard, n)``, rows counted by group and shard.

    Tables ``grp, label`` of large groups (``LARGE`` a shard at most) and of the others, and the ``(shard, rows)`` pieces of groups that are spread.
    """
    room, spread = list(quotas), {}
    votes = F.collect_list(F.struct("n", "shard"))  # a row for each shard at most
    groups = Stored(held.groupBy("grp").agg(F.sum("n").alias("size"), votes.alias("votes")).filter("size > 1"), "shard-groups")
    class_of = F.lit(0)
    borders = [max(quotas) // (1 << k) for k in range((LARGE - 1).bit_length() + 1)]  # a quota, its half, and so on to the 16th part
    for b in borders:
        class_of = class_of + (F.col("size") <= b).cast("int")
    last = len(borders)
    there = sorted(x[0] for x in groups.df.select(class_of.alias("c")).distinct().collect())
    settled: dict[bool, list[DataFrame]] = {True: [], False: []}
    r = 0
    for k in there:
        waiting, left = groups.df.filter(class_of == k), {}
        while True:
            asked = Stored(_round(waiting, room, r), f"shard-round-{r}").df
            r += 1
            for x in asked.filter("target is null").collect():
                left[x["grp"]] = (x["size"], {v["shard"]: v["n"] for v in x["votes"]})
            asked = asked.filter("target is not null")
            taken = _accepted(asked, room)
            settled[k < last].append(asked.filter(taken).select("grp", F.col("target").alias("label")))
            waiting = asked.filter(~taken).drop("target", "turn")
            if not waiting.take(1):
                break
        for grp in sorted(left, key=lambda g: (-left[g][0], g)):
            spread[grp] = _spread(left[grp][1], left[grp][0], room)

    def union(tables: list[DataFrame]) -> DataFrame:
        whole = groups.df.limit(0).select("grp", F.lit(0).alias("label"))
        for t in tables:
            whole = whole.unionByName(t)
        return whole

    return union(settled[True]), union(settled[False]), spread


def _in_order(rows: DataFrame, keys: list[str], tag: str) -> tuple[Stored, DataFrame]:
    """``rows`` sorted over all partitions by ``keys``, stored, and read with ``_part`` and ``_seq``, the places within a partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    stored = Stored(numbered, tag)
    return stored, stored.df


def _assign(slim: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to ``slim(doc_id, grp, ...)``."""
    spark = slim.sparkSession
    total = slim.count()
    quotas = [total // shards + (t < total % shards) for t in range(shards)]
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    large, small, pieces_of = propagate(slim.groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n")), quotas)
    # a label is a shard, ``shards`` for rows without links, or one of its own for a group that is spread
    labels = {grp: shards + 1 + k for k, grp in enumerate(pieces_of)}
    spread = list(pieces_of.values())
    named = large.unionByName(spark.createDataFrame(list(labels.items()), "grp string, label int"))  # some for each shard
    rows = slim.join(F.broadcast(named), "grp", "left")
    rest = rows.filter("label is null").drop("label").join(small, "grp", "left")
    rows = rows.filter("label is not null").unionByName(rest.select(*rows.columns))
    # one total order: the linked rows label by label with groups together; the rows without links are a label too
    by_label, rows = _in_order(rows.withColumn("label", F.coalesce("label", F.lit(shards))), ["label", "grp", "doc_id"], "shard-labels")
    counts = rows.groupBy("_part", "label").agg(F.count("*").alias("n")).collect()
    before, load = dict.fromkeys((c["_part"] for c in counts), 0), dict.fromkeys(range(shards + 1 + len(spread)), 0)
    for c in counts:
        before[c["_part"]] += c["n"]
        load[c["label"]] += c["n"]
    # the pieces of the order, each with the shard where it goes
    first, used = _running(load), [load[t] for t in range(shards)]
    pieces = [(t, first[t], first[t] + load[t], t) for t in range(shards)]
    for label in [*range(shards + 1, len(load)), shards]:
        at = first[label]
        for t, n_rows in [(t, quotas[t] - used[t]) for t in range(shards)] if label == shards else spread[label - shards - 1]:
            pieces.append((label, at, at + n_rows, t))
            used[t] += n_rows
            at += n_rows
    # a row for each partition
    starts = spark.createDataFrame(list(_running(before).items()), "_part int, _before bigint")
    # a table of some rows for each shard; the label makes it an equality join
    table = spark.createDataFrame([p for p in pieces if p[2] > p[1]], "label int, _lo bigint, _hi bigint, shard int")
    ranked = rows.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_before") + F.col("_seq")).drop("_part", "_seq", "_before").withColumnRenamed("label", "_label")
    here = (F.col("_label") == F.col("label")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at_home = ranked.join(F.broadcast(table), here).drop("_label", "label", "_lo", "_hi")

    # slots: a random order within each shard, so copies don't follow one another; a rank makes equal rows differ
    mixed, rows = _in_order(at_home.withColumn("_key", F.xxhash64("_rank", "doc_id")), ["shard", "_key", "_rank"], "shard-slots")
    by_label.drop()
    counts = rows.groupBy("_part", "shard").agg(F.count("*").alias("n")).collect()
    parts: dict[int, int] = {}
    for c in counts:
        parts[c["_part"]] = parts.get(c["_part"], 0) + c["n"]
    starts = spark.createDataFrame(list(_running(parts).items()), "_part int, _before bigint")
    shard_first = spark.createDataFrame(list(_running(dict(enumerate(quotas))).items()), "shard int, _first bigint")
    slot = (F.col("_before") + F.col("_seq") - F.col("_first")).alias("slot")
    return rows.join(F.broadcast(starts), "_part").join(F.broadcast(shard_first), "shard").select(*slim.columns, "shard", slot)


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, grp`` of ``docs(doc_id, text)``."""
    slim = Stored(describe(docs), "shard-rows")
    placed = _assign(slim.df, shards)
    slim.drop()
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp")


def _running(sizes: dict[int, int]) -> dict[int, int]:
    """What stands before each key, in order of the keys."""
    out, at = {}, 0
    for k in sorted(sizes):
        out[k], at = at, at + sizes[k]
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot``; columns of these names are replaced.

    The rows are written once with a number each, so equal rows are told apart; whole texts are shuffled once, on that number.
    """
    base = without(docs, "shard", "slot")
    number = unused(base, "_row")
    whole = Stored(base.withColumn(number, F.monotonically_increasing_id()), "shard-documents").df
    slim = Stored(describe(whole, number).drop("size", "text_crc32"), "shard-rows")
    placed = _assign(slim.df, shards).select(number, "shard", "slot")
    slim.drop()
    return whole.join(placed, number).select(*base.columns, "shard", "slot")
