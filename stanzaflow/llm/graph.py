"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_STEPS = 60


def _min_neighbour(both: DataFrame) -> DataFrame:
    """``u, m``: the smallest of each node and its neighbours; summed up before the shuffle."""
    return both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Re-hang neighbours on their node's smallest neighbour: larger ones, or those not larger."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(_min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _min_neighbour(down)
        hung = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(u, v)``; the component is its smallest node.

    The steps end when the edges no longer change: then each node hangs on its component's smallest.
    Ids must not be null.  No step makes pairs of a node's neighbours, so stars of any size are fine.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(MAX_STEPS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        now = cut(_star(_star(now, large=True), large=False))
    raise RuntimeError("the components did not settle")
