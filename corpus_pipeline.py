"""From documents to shards of a training mix: five stages, each a table that the next one reads.

quality classifier, near-duplicates, decontamination and mixing return the
columns of documents, whatever their names; sharding returns each row's digest
and place.

A null or empty text is scored like any other, has no near-duplicate, holds no
benchmark item, and has size 0 in the mix. Rows repeated throughout are one
document to the near-duplicate stage, which keeps one of them, unless they have
no words. A null id counts as the largest. Without a label that says what is
bad, all documents pass the classifier; without benchmark items, none is
contaminated; without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexifacet.llm import decontam, minhash, mixing, quality, sharding
from lexifacet.llm.common import Scratch
from lexifacet.llm.queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity from 0.8."""
    return minhash.keep_one(docs, 5, 80, 100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold most of a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and a seeded similarity join are not expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
