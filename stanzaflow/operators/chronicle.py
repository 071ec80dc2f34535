"""Years side by side: scenes of years that follow one another, the segments between them, and stretches nobody can fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scenes(rows: DataFrame, key: str, value: str, gap: int = 1) -> DataFrame:
    """``key, scene, first, last, n_values, n_rows``: islands of whole numbers (years, days) no more than ``gap`` apart.

    Rows are summed up by key and value first, so what is sorted for a key is the span of its values, not its rows.  Rows
    without a value are in no scene.
    """
    days = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = W.partitionBy(key).orderBy("_v")
    new = F.coalesce(F.col("_v") - F.lag("_v").over(order) > gap, F.lit(True)).cast("int")
    marked = days.withColumn("_new", new).withColumn("scene", F.sum("_new").over(order).cast("int"))
    return marked.groupBy(key, "scene").agg(F.min("_v").alias("first"), F.max("_v").alias("last"), F.count("*").alias("n_values"), F.sum("_c").alias("n_rows"))


def segments(found: DataFrame, key: str, far: int) -> DataFrame:
    """``key, from_scene, to_scene, gap, resolved``: what lies between a key's scenes; a gap of more than ``far`` is unresolved."""
    order = W.partitionBy(key).orderBy("scene")
    nxt = found.select(key, "scene", "last", F.lead("scene").over(order).alias("to_scene"), F.lead("first").over(order).alias("_first")).filter("to_scene is not null")
    gap = F.col("_first") - F.col("last")
    return nxt.select(key, F.col("scene").alias("from_scene"), "to_scene", gap.alias("gap"), (gap <= far).alias("resolved"))


def stories(found: DataFrame, between: DataFrame, key: str) -> DataFrame:
    """``key, scene_count, segment_count, unresolved_count, first, last, longest``: a row for each key; the counts are those of its scenes and segments."""
    own = found.groupBy(key).agg(F.count("*").alias("scene_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.col("last") - F.col("first") + 1).alias("longest"))
    gaps = between.groupBy(key).agg(F.count("*").alias("segment_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))
    zero = {"segment_count": 0, "unresolved_count": 0}
    return own.join(gaps, key, "left").na.fill(zero).select(key, "scene_count", "segment_count", "unresolved_count", "first", "last", "longest")
