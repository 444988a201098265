"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the last one adds its shard to the
columns of documents, the others return those columns as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, mixing, near_copies, quality_fm, sharding
from quadrille.llm.common import columns, stored, table, unused
from quadrille.llm.queries import SHARD_BYTES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine finds good."""
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    verdict = unused(docs, "predicted")
    return quality_fm.score(docs, machine).filter(f"{verdict} = 1").select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Jaccard 0.8 or more on shingles of five words."""
    return near_copies.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    return mixing.take(mixing.mix(docs), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they go to."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: A factorisation machine and edit distances inside texts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
