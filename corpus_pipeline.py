"""A training-corpus pipeline of five stages over the documents table.

Every stage is one of the operators of ``tessera.llm``; each works on all that
its predecessor kept.  Stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, scratch, staged
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.mixing import take_mix
from tessera.llm.near_duplicates import keep_one_of_each
from tessera.llm.quality import keep_good
from tessera.llm.sharding import shard_by_bytes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them (0 to 3 times)."""
    return take_mix(docs, F.array("source"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document taken."""
    return shard_by_bytes(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the near-duplicate components and the model of the first
#: stage; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again.

    What a stage stages on its way, and its predecessor's result, are removed
    when its own result is written, and all of it after a failure; the input
    of the last stage stays in the shared folder until the result was used.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as results:
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = staged(stage(spark, docs, sf_dir), name, results)
            discard(spark, results[:-1])
            del results[:-1]
        results.clear()
    return STAGES[-1][1](spark, docs, sf_dir)
