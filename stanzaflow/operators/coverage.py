"""Roll-ups: coverage by several levels, catalogs, status counts, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_levels(rows: DataFrame, first: str, second: str, buckets: dict[str, Column]) -> DataFrame:
    """Counts by (first, second), by first, and in all, with one column for each status bucket.

    One pass: the grouping sets are expanded before the partial aggregation.
    """
    spark = rows.sparkSession
    flagged = rows.select(first, second, *[c.cast("int").alias(n) for n, c in buckets.items()])
    sums = ", ".join(f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in buckets)
    return spark.sql(
        f"SELECT {first}, {second}, CAST(grouping_id({first}, {second}) AS INT) AS level, count(*) AS total, {sums} "
        f"FROM {{rows}} GROUP BY GROUPING SETS (({first}, {second}), ({first}), ())",
        rows=flagged,
    )


def majority_catalog(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """``group, label, n, first_seen``: the label most rows of a group have, ties to the one seen first."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("early"), label)).alias("b")
    return counts.groupBy(group).agg(best, F.sum("n").alias("n"), F.min("first").alias("first_seen")).select(group, F.col(f"b.{label}").alias(label), "n", "first_seen")


def status_counts(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def tier_coverage(rows: DataFrame, tier: str, key: str, group: str, total: int | Column) -> DataFrame:
    """Distinct keys and groups for each tier and over all tiers, with the percentage of all keys, one place."""
    one = rows.groupBy(tier).agg(F.countDistinct(key).alias("keys"), F.countDistinct(group).alias("groups"))
    every = rows.agg(F.countDistinct(key).alias("keys"), F.countDistinct(group).alias("groups")).select(F.lit("combined").alias(tier), "keys", "groups")
    size = total if isinstance(total, Column) else F.lit(total)
    return one.withColumn(tier, F.col(tier).cast("string")).unionByName(every).withColumn("percent", F.round(F.col("keys") * 100.0 / size, 1))


def distinct_union(parts: list[DataFrame], group: str, id_col: str) -> DataFrame:
    """Distinct ids of each group over several sources."""
    both = parts[0].select(group, id_col)
    for p in parts[1:]:
        both = both.unionByName(p.select(group, id_col))
    return both.groupBy(group).agg(F.countDistinct(id_col).alias("n"))


def full_profile(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several tables side by side over the union of their keys, zero where a table has none."""
    out = None
    for name, df in parts.items():
        own = df.groupBy(key).agg(F.count("*").alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out.na.fill(0, list(parts))


def imagined_rate(rows: DataFrame, key: str, dreamed: Column, composed: Column, least: int = 2) -> DataFrame:
    """dreamed / (composed + dreamed), null below ``least`` rows."""
    g = rows.groupBy(key).agg(F.count_if(dreamed).alias("dreamed"), F.count_if(composed).alias("composed"))
    n = F.col("dreamed") + F.col("composed")
    return g.withColumn("imagined_rate", F.when(n >= least, F.round(F.col("dreamed") / n, 4)))


def joined_texts(rows: DataFrame, group: str, order: list[str], text: str, between: str) -> DataFrame:
    """``group, joined``: the texts of each group in order; groups must be of bounded size, as the turns of a conversation are."""
    own = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(own, lambda x: x["_text"]), between).alias("joined"))
