"""Writers: canonical JSON lines, CSV, versioned tables with a manifest, change detection, file manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import BOM


def canonical(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Columns by name and rows in a total order whose last tie-break is the row itself as JSON."""
    columns = sorted(df.columns)
    whole = df.select(*columns)
    return whole.orderBy(*(order or []), F.to_json(F.struct(*columns)))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    canonical(df, order).write.json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """CSV of the given columns; with ``mark`` each file starts with a byte-order mark, as spreadsheets want it."""
    named = df.select(F.col(columns[0]).alias(BOM + columns[0]) if mark else F.col(columns[0]), *columns[1:])
    named.write.csv(path, header=True, escape='"')


def digest_sums(df: DataFrame, row: Column) -> DataFrame:
    """One row ``n, s0 .. s3``: the rows and the sums of four parts of their SHA-256 ``row``; the order of rows doesn't matter."""
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return df.agg(F.count("*").alias("n"), *parts)


def content_digest(df: DataFrame, ignore: tuple[str, ...] = ()) -> str:
    """A digest of the rows as a multiset, whatever their order, without the ignored columns; one pass, one row to the driver."""
    columns = sorted(c for c in df.columns if c not in ignore)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return json.dumps([str(x) for x in digest_sums(df, row).first()] + columns)


def publish(df: DataFrame, root: str, ignore: tuple[str, ...] = (), check: Callable[[DataFrame], bool] | None = None) -> bool:
    """Write a new version and then name it in the manifest, unless nothing but ignored columns has changed.

    Readers see the old version until the manifest row is there, so a job that fails half way, or rows that don't pass
    ``check``, change nothing.
    """
    spark = df.sparkSession
    digest = content_digest(df, ignore)
    last = latest(spark, root)
    if last is not None and last["digest"] == digest:
        return False
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    if check is not None and not check(spark.read.schema(df.schema).parquet(f"{root}/{version}")):
        raise ValueError("the new version failed its check and isn't published")
    number = (last["published_no"] if last is not None else 0) + 1
    row = spark.createDataFrame([(number, version, digest)], "published_no bigint, version string, digest string")
    try:  # a folder for each number: of two writers that publish the same one, the second fails
        row.coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/no={number:09d}")
    except AnalysisException as e:
        raise RuntimeError(f"version {number} was published by another writer meanwhile") from e
    return True


def latest(spark: SparkSession, root: str):
    """The manifest's last row, or none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("published_no bigint, version string, digest string").option("recursiveFileLookup", "true").json(f"{root}/manifest").orderBy(F.desc("published_no")).first()


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, size, modified, sha256`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
