"""The training-data pipeline: five stages over ``documents``, each the work of one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` applies them in order, each stage's rows written as Parquet and read again.

Defined cases, for every stage: a null or empty text is no toxic text, no near duplicate and holds no benchmark passage, so
its row passes the first three stages; rows without a doc_id pass too; a text of any length is taken whole; an empty table
gives an empty one; extra columns, whatever their names, are kept.  Of rows equal in doc_id and text the near-duplicate stage
keeps one, and rows that share a doc_id with other texts are decided on each by its own text; no other stage drops repeated
rows.  Ties are settled by ids and hashes, as the operators tell.  The mixing stage deals the rows out in a global random order; the
sharding stage puts copies of a text into one shard, and its slots are a random order within each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stanzaflow.llm import decontam, minhash, mixing, sharding, toxicity
from stanzaflow.llm.common import Stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose expected grade is toxic (operator 1)."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates of 80 per cent or more (operator 4, whose own query takes 85)."""
    return minhash.drop_near_duplicates(docs, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item (operator 8)."""
    return decontam.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' target weights and shuffle them globally (operator 6)."""
    return mixing.mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into shards of equal counts, copies together (operator 10)."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained model, similarity components and label propagation can't be told in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are deleted once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs
