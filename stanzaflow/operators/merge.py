"""Keyed merges: upserts with different precedence, scoped refresh, set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _full(old: DataFrame, new: DataFrame, keys: list[str]):
    a, b = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return a.join(b, on, "full_outer")


def upsert_existing_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored values stay, empty texts included; new rows and nulls are filled."""
    return _full(old, new, keys).select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old.columns])


def upsert_incoming_wins(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Incoming values win, but for the reviewers' fields ``keep``, whose stored value stays unless it is empty."""
    pick = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}")) if c in keep else F.coalesce(f"n.{c}", f"o.{c}")
    return _full(old, new, keys).select(*[pick(c).alias(c) for c in old.columns])


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in a total order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def upsert_last_row(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows are replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*old.columns))


def refresh_scopes(old: DataFrame, new: DataFrame, done: DataFrame, scope: list[str], keys: list[str], keep: list[str]) -> DataFrame:
    """In the scopes that were collected with success, rows that vanished go; survivors keep the reviewers' fields."""
    outside = old.join(done, scope, "left_anti")
    inside = old.join(done, scope, "left_semi").join(new.select(*keys), keys, "left_semi")
    return upsert_incoming_wins(outside.unionByName(inside), new, keys, keep)


def upsert_keep_done(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str, status_col: str, done: str = "completed", fresh: str = "pending") -> DataFrame:
    """A job stays done while its input hash is unchanged; otherwise it is pending again with the new values."""
    joined = _full(old, new, keys)
    same = F.col(f"o.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}")) & (F.col(f"o.{status_col}") == done)
    is_new = F.col(f"n.{keys[0]}").isNotNull()

    def pick(c):
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}")
        value = F.lit(fresh) if c == status_col else F.col(f"n.{c}")
        return F.when(is_new & ~F.coalesce(same, F.lit(False)), value).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b``: both zero if the row sets are equal."""
    x = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    y = b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return x.crossJoin(y)  # one row each


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dense_index_check(rows: DataFrame, index: str) -> DataFrame:
    """Whether an index is the dense range 0 to n - 1."""
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct(index).alias("n_distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    return counts.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))


def dense_by_group(rows: DataFrame, group: str, index: str) -> DataFrame:
    """``group, dense``: whether each group's indexes go up by one without a gap or a repeat; no window, partial sums only."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return g.select(group, ((F.col("n") == F.col("d")) & (F.col("high") - F.col("low") == F.col("n") - 1)).alias("dense"))


def collapse_versions(rows: DataFrame, key: list[str], source_id: str, body_hash: str, order: list) -> DataFrame:
    """One row for each (key, source id), or each (key, body hash) where the source id is missing: the last in order, and ``collapsed``, how many went."""
    ident = F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim(F.col(source_id).cast("string")), F.lit(""))), F.concat(F.lit("body:"), F.col(body_hash)))
    by = W.partitionBy(*key, "_ident")
    place = F.row_number().over(by.orderBy(*order))
    marked = rows.withColumn("_ident", ident).withColumn("_n", place).withColumn("collapsed", F.count("*").over(by) - 1)
    return marked.filter("_n = 1").drop("_n", "_ident")
