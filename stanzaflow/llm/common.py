"""Helpers shared by the training-data operators: scratch storage and small table utilities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 4096  # a key is hot if it holds more than this part of all rows, so there are no more hot keys than that
HOT_ROWS = 512  # and no key with fewer rows is hot


# rows and bytes of an Arrow batch on its way to a worker: whole texts make Spark's default of 10000 rows large
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "4m")}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches where they stand at Spark's defaults; a size that the user has set stays."""
    given = spark.sparkContext.getConf()
    for key, (default, lower) in BATCHES.items():
        if not given.contains(key) and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, lower)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be in any store Spark can read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine is a temporary folder made; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stanzaflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A DataFrame written as Parquet in the shared folder; ``df`` reads it back."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case: ``name``, with lines added behind it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) the operator is about to write."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def join_hot(left: DataFrame, right: DataFrame, key: list[str], by: str, sizes: DataFrame, total: int, size: str = "size") -> DataFrame:
    """Inner join on ``key`` in which hot keys of ``left`` don't land in one task.

    ``sizes`` tells by key, in the column ``size``, how many of the ``total`` left rows have it.  A key with more than 1 / ``HOT_KEYS`` of
    them is dealt over several tasks by a hash of the column ``by``, and its right rows are sent to each.  The table of hot
    keys is broadcast; it has ``HOT_KEYS`` rows at most, whatever the input.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    parts = cut(sizes.filter(F.col(size) > bound).select(*key, F.ceil(F.col(size) / bound).cast("int").alias("_parts")))
    if not parts.take(1):
        return left.join(right, key)
    number = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(parts), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), number).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(parts), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")
    return dealt.join(copies, [*key, "_part"]).drop("_part")


SAMPLE_PARTS = 16  # hash parts that a sample is taken from, so that no task sorts all of it


def first_by_hash(rows: DataFrame, group: str, n: int, by: str = "doc_id") -> DataFrame:
    """At most ``n`` rows of each group, those with the smallest hashes of ``by`` in each of ``SAMPLE_PARTS`` parts, as ``by, group``.

    Groups are counted first, and only rows whose hash is small enough to be among one and a half times as many go on,
    so no task gets more than that of a group, however large it is, as long as ids don't repeat: rows of one id share their hash, and stand
    in one part together.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))  # a row for each group: classes or languages
    share = F.least(F.lit(1.0), F.lit(1.5 * n) / F.col("_n"))
    small = F.col("_hash") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    part = F.pmod(F.xxhash64(by, F.lit("part")), F.lit(SAMPLE_PARTS))
    near = rows.select(by, group, F.xxhash64(by).alias("_hash"), part.alias("_part")).join(F.broadcast(counts), group).filter(small)
    place = F.row_number().over(W.partitionBy(group, "_part").orderBy("_hash", by))
    each = F.when(F.col("_n") <= n, F.lit(n)).otherwise(F.lit(n // SAMPLE_PARTS))  # a small group is taken whole
    return near.withColumn("_place", place).filter(F.col("_place") <= each).select(by, group)
