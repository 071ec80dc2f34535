"""Total orders over all partitions: numbered rows, and values carried on from row to row.

A window over a key sorts all rows of the key in one task.  Here rows are sorted by range over all partitions, stored, and joined with
one row for each partition, so a key of any size is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

_SEQ_BITS = (1 << 33) - 1  # of Spark's increasing ids, the place of a row within its partition


def parts_for(rows: DataFrame, each: int = 1 << 19) -> int:
    """How many partitions keep a task at about ``each`` rows, the session's number at least; the rows are counted for it."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def in_order(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part`` and ``_seq``: partitions that follow one another in the order, and places from 0 within each.

    The result is a stored table: whatever is worked out from it sees the same partitions.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQ_BITS)))
    return stored(marked, "in-order")


def numbered(rows: DataFrame, *order, name: str = "_n", parts: int | None = None) -> DataFrame:
    """Adds ``name``, the place of each row from 0 in a total order; no row is lost or repeated, whatever its columns."""
    whole = in_order(rows, list(order), parts)
    counts = whole.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return whole.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_seq")).drop("_part", "_seq", "_before")


def carried(rows: DataFrame, key: list[str], order: list, values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds for each name of ``values`` the last value that isn't null among the rows of the key up to and including each row.

    ``order`` is the total order within a key, columns or their descending forms.  Within a partition a window does it; what comes in from the
    partitions before is one row for each key that crosses a border, which is at most one key for each border.
    """
    whole = in_order(rows, [*key, *order], parts)
    inside = W.partitionBy("_part", *key).orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    own = whole.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_own_{name}") for name, v in values.items()])
    # the last values of each key's stretch in a partition, for stretches that reach the end of their partition
    ends = whole.groupBy("_part").agg(F.max("_seq").alias("_seq"))
    last = own.join(F.broadcast(ends), ["_part", "_seq"]).select("_part", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], *[f"_own_{n}" for n in values])
    earlier = W.partitionBy(*[f"_key{i}" for i in range(len(key))]).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)  # a row for each partition at most
    last = last.select("_part", *[f"_key{i}" for i in range(len(key))], *[F.last(f"_own_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in values])
    # a partition's first key gets what the nearest partition before it with that key ends with: all between hold that key only
    first = whole.filter("_seq = 0").select("_part", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)])
    same = None
    for i in range(len(key)):
        c = F.col(f"f._key{i}").eqNullSafe(F.col(f"l._key{i}"))
        same = c if same is None else same & c
    before = first.alias("f").join(F.broadcast(last.alias("l")), same & (F.col("l._part") < F.col("f._part")), "left")
    nearest = before.groupBy("f._part", *[F.col(f"f._key{i}") for i in range(len(key))]).agg(F.max_by(F.struct(*[F.col(f"l._in_{n}").alias(n) for n in values]), "l._part").alias("_carry"))
    nearest = nearest.select(F.col("_part").alias("_p"), *[f"_key{i}" for i in range(len(key))], "_carry")
    matches = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        matches &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = own.join(F.broadcast(nearest), matches, "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_own_{n}", f"_carry.{n}").alias(n) for n in values])
