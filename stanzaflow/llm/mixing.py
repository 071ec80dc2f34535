"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output's bytes over its share of the
input's.  Each document is repeated as often as a Poisson variable with that mean says; the
variable is made by inverting the distribution function at a uniform number hashed from the seed and
the document's id, so a rerun after a lost executor gives the same copies.  Rates above ``STEP`` are
parts of at most ``STEP`` added up, which has the same distribution and keeps the tables short.
The copies are then dealt out by a hash and sorted by it within each partition: a global shuffle.

Only DataFrame functions are used.  Sources are summed before anything is joined; at most ``BROADCAST_SOURCES`` rows of
the rate table are broadcast, those of the largest sources.

Defined cases: a null source is a source of its own; a source without bytes has rate 1; a source
without a target weight gets weight 0; a null doc_id is hashed as the text ``null``; repeated rows get
the same number of copies each; null and empty texts are copied like others; a text's length isn't limited; an empty
table gives an empty result; columns of the input with the names of output columns are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused, without

SEED = "mix-1"
TEMPERATURE = 0.5  # default target: shares proportional to bytes to this power
STEP = 8.0  # the largest mean inverted at once
TERMS = 64  # of the distribution function; P(X >= 64) at mean 8 is below 1e-30
BROADCAST_SOURCES = 10_000
_BITS = 52


def _uniform(text):
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << _BITS))


def repetition_rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, n_bytes, n_docs, rate`` for each source; ``targets(source, weight)`` may give the weights."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    sources = docs.groupBy("source").agg(F.sum(size).alias("n_bytes"), F.count("*").alias("n_docs"))
    if targets is None:
        weighted = sources.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(temperature)))
    else:
        own = targets.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = sources.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n_bytes", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighted.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("n_bytes")
    return weighted.crossJoin(F.broadcast(total)).select(  # one row on the right
        "source", "n_bytes", "n_docs", F.when((F.col("n_bytes") > 0) & (F.col("all_weight") > 0), F.round(rate, 9)).otherwise(F.lit(1.0)).alias("rate")
    )


def _with_thresholds(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``: the distribution function of a part's Poisson variable."""
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def term(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rates.withColumn("parts", parts).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term)["cdf"])


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: str = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """Each row of ``docs`` as often as drawn, in a global random order.

    Adds ``rate``, ``n_copies``, ``copy`` (from 0) and ``shuffle_key``, by which the partitions are sorted.
    """
    spark = docs.sparkSession
    added = ["rate", "n_copies", "copy", "shuffle_key"]
    base = without(docs, *added)
    m = unused(base, "_mix")
    rates = cut(_with_thresholds(repetition_rates(docs, targets, temperature)).select(F.struct("source", "n_docs", "rate", "parts", "cdf").alias(m)))
    by_source = F.col("source").eqNullSafe(F.col(f"{m}.source"))
    if rates.count() <= BROADCAST_SOURCES:
        rated = base.join(F.broadcast(rates), by_source)
    else:  # sources of more than a BROADCAST_SOURCES-th part of all rows by broadcast, the small ones by a shuffle
        hot = rates.crossJoin(F.broadcast(rates.agg(F.sum(f"{m}.n_docs").alias("all_docs")))).filter(F.col(f"{m}.n_docs") * BROADCAST_SOURCES > F.col("all_docs")).select(m)
        hot = F.broadcast(cut(hot))
        cold = rates.join(hot.select(F.col(f"{m}.source").alias("_hot")), F.col(f"{m}.source").eqNullSafe(F.col("_hot")), "left_anti")
        rated = base.join(hot, by_source).unionByName(base.join(hot, by_source, "left_anti").join(cold, by_source))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"))

    def drawn(j):
        u = _uniform(F.concat(name, j.cast("string")))
        return F.size(F.filter(f"{m}.cdf", lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.col(f"{m}.parts")), F.lit(0), lambda acc, j: acc + drawn(j))
    copies = (
        rated.withColumn("n_copies", n)
        .filter("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    )
    key = F.conv(F.substring(F.md5(F.concat(name, F.lit("copy:"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    mixed = copies.select(*base.columns, F.col(f"{m}.rate").alias("rate"), "n_copies", "copy", key.alias("shuffle_key"))
    n_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartition(n_out, "shuffle_key").sortWithinPartitions("shuffle_key")
