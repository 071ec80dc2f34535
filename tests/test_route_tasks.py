"""What a task holds of the routes stays bounded."""

from pyspark.sql import functions as F

from stanzaflow.operators import promotion
from stanzaflow.operators.order import parts_for


def test_more_rows_are_more_tasks(spark):
    nodes = spark.range(2_500_000).select(F.floor(F.col("id") / 2).alias("r"), (F.col("id") % 2).alias("o"), F.col("id").alias("n"))
    assert parts_for(nodes) == 5 and parts_for(nodes.limit(3)) == 4
    legs = promotion.route_legs(nodes, "r", "o", "n", F.col("n") >= 0)
    ways = legs.filter("r % 1000 = 0").select("r", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("by boat").alias("note"))
    told, counts = promotion.assembled_routes(nodes, legs, ways, "r", "n", [("water", "boat")])
    assert told.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in told.groupBy("direction", "mode", "basis").count().orderBy("direction").collect()] == [(None, None, None, 1_248_750), ("reversed", "water", "boat", 1250)]
    assert tuple(counts.agg(F.sum("n_nodes"), F.sum("n_legs"), F.sum("n_documented")).first()) == (2_500_000, 1_250_000, 1250)
