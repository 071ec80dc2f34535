"""Several tables read and replaced as one set.

A set is a folder of tables and a manifest.  One row of the manifest pins every table of a version, so readers who take their tables from one
row see all of them as they were published together; the row is written last, so a write that fails half way changes
nothing, and an old row can be pinned again.  Tables that are carried over aren't copied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import content_digest

_ROW = "number bigint, tables string, facts string, digests string"


class Snapshot:
    """One version of a set: ``number``, ``tables`` (folders by name), ``facts`` (numbers and texts that belong to it)."""

    def __init__(self, spark: SparkSession, root: str, row):
        self.spark, self.root = spark, root
        self.number = row["number"] if row else 0
        self.tables: dict[str, str] = json.loads(row["tables"]) if row else {}
        self.facts: dict = json.loads(row["facts"]) if row else {}
        self.digests: dict[str, str] = json.loads(row["digests"]) if row else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.tables[name]}")


def _rows(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_ROW).option("recursiveFileLookup", "true").json(f"{root}/manifest")


def current(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The last version of a set, or one by its number; a set that was never published has number 0 and no tables."""
    rows = _rows(spark, root)
    if rows is None:
        if number:
            raise ValueError(f"the set has no version {number}")
        return Snapshot(spark, root, None)
    chosen = rows if number is None else rows.filter(F.col("number") == number)
    row = chosen.orderBy(F.desc("number")).first()
    if row is None and number:
        raise ValueError(f"the set has no version {number}")
    return Snapshot(spark, root, row)


def _pin(spark: SparkSession, root: str, before: Snapshot, tables: dict[str, str], facts: dict, digests: dict[str, str]) -> Snapshot:
    number = before.number + 1
    row = [(number, json.dumps(tables, sort_keys=True), json.dumps(facts, sort_keys=True), json.dumps(digests, sort_keys=True))]
    try:  # a folder for each number: of two writers that pin the same one, the second fails
        spark.createDataFrame(row, _ROW).coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/no={number:09d}")
    except AnalysisException as e:
        raise RuntimeError(f"version {number} of the set was published by another writer meanwhile") from e
    return current(spark, root, number)


def publish_set(
    spark: SparkSession,
    root: str,
    tables: dict[str, DataFrame],
    keep: list[str] | None = None,
    facts: dict | Callable[[Snapshot], dict] | None = None,
    partition_by: dict[str, list[str]] | None = None,
    check: Callable[[dict[str, DataFrame]], bool] | None = None,
    skip_equal: bool = False,
) -> Snapshot:
    """Write ``tables`` and pin them as the next version, together with the tables of ``keep`` (all others, if not given) from the last one.

    ``facts`` may be a function of the version that is about to be pinned (the last version's are kept, if none are given).
    ``check`` sees the new tables as they were written and may refuse the set.  With ``skip_equal`` a table whose rows are those of the
    last version keeps its old folder, and if that holds for all of them nothing is published.
    """
    before = current(spark, root)
    pinned = {n: before.tables[n] for n in (before.tables if keep is None else keep) if n not in tables}
    digests = {n: before.digests[n] for n in pinned if n in before.digests}
    written: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if skip_equal:
            digests[name] = content_digest(df)
            if before.digests.get(name) == digests[name]:
                pinned[name] = before.tables[name]
                continue
        folder = f"{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by[name]) if partition_by and name in partition_by else df.write
        writer.parquet(f"{root}/{folder}")
        pinned[name] = folder
        written[name] = spark.read.parquet(f"{root}/{folder}")
    coming = Snapshot(spark, root, {"number": before.number + 1, "tables": json.dumps(pinned), "facts": "{}", "digests": json.dumps(digests)})
    facts = before.facts if facts is None else facts(coming) if callable(facts) else facts
    if skip_equal and not written and pinned == before.tables and facts == before.facts:
        return before
    if check is not None and not check(written):
        raise ValueError("the new tables failed their check and aren't published")
    return _pin(spark, root, before, pinned, facts, digests)


def roll_back(spark: SparkSession, root: str, number: int) -> Snapshot:
    """Pin the tables of an old version again, as the next one."""
    old = current(spark, root, number)
    return _pin(spark, root, current(spark, root), old.tables, old.facts, old.digests)


def settled(spark: SparkSession, root: str, names: list[str], read: Callable[[Snapshot], DataFrame], tries: int = 3) -> tuple[Snapshot, DataFrame]:
    """What ``read`` makes of one version of the set, which must hold the ``names``; a version that lacks some is looked up anew."""
    for _ in range(tries):
        snapshot = current(spark, root)
        if set(names) <= set(snapshot.tables):
            return snapshot, read(snapshot)
    raise ValueError(f"the set lacks {sorted(set(names) - set(snapshot.tables))}")
