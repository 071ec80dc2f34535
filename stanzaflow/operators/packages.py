"""Nested records: claims of several kinds put together as one package for each work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(values: Column, order: Column) -> Column:
    """The values of the first row in an order, as an aggregate."""
    return F.min_by(values, order)


def packages(claims: DataFrame, key: str, kind: str, value: str, claim_id: str, confidence: str, source: str, locator: str, single: list[str], listed: list[str]) -> DataFrame:
    """``key, composition, notes, sources, controversy, quality``: one nested record for each key.

    ``composition`` has for each kind of ``single`` a struct: the ``value`` of the claim with the greatest confidence (ties to the smallest
    id, then value), and the number of claims and of distinct values.  ``notes`` has for each kind of ``listed`` its distinct values in order.  ``sources`` are the distinct
    sources with their first locator.  ``controversy`` names the single kinds whose claims give several values.  ``quality`` tells what is
    there, and ``complete`` whether all is.

    Claims are summed up by key, kind and value first and their sources by key and source, so the arrays hold what differs, not every claim.
    """
    values = claims.filter(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, kind, value).agg(
        F.count("*").alias("_n"), F.min(F.struct((-F.col(confidence)).alias("c"), F.col(claim_id).alias("id"), F.col(value).alias("v"))).alias("_best")
    )
    parts = []
    for k in single:
        own = F.when(F.col(kind) == k, F.col("_best"))
        parts.append(F.struct(F.min_by(value, own).alias("value"), (-F.min(own)["c"]).alias("confidence"), F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("_n"))), F.lit(0)).alias("n_claims"), F.count_if(F.col(kind) == k).alias("n_values")).alias(k))
    notes = [F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.col(value)))).alias(k) for k in listed]
    whole = values.groupBy(key).agg(F.struct(*parts).alias("composition"), F.struct(*notes).alias("notes"))
    cited = claims.filter(F.col(source).isNotNull()).groupBy(key, source).agg(F.min(locator).alias("locator"), F.count("*").alias("n"))
    cited = cited.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), "locator", "n"))).alias("sources"))
    joined = whole.join(cited, key, "left")
    torn = F.array_compact(F.array(*[F.when(F.col(f"composition.{k}.n_values") > 1, F.lit(k)) for k in single]))
    there = [F.col(f"composition.{k}.value").isNotNull().alias(k) for k in single] + [(F.size(f"notes.{k}") > 0).alias(k) for k in listed]
    quality = joined.withColumn("sources", F.coalesce("sources", F.array().cast(cited.schema["sources"].dataType))).withColumn("controversy", torn).withColumn("quality", F.struct(*there))
    complete = F.lit(True)
    for k in [*single, *listed]:
        complete &= F.col(f"quality.{k}")
    return quality.withColumn("complete", complete).select(key, "composition", "notes", "sources", "controversy", "quality", "complete")
