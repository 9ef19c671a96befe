"""A training corpus from raw documents, in five stages.

Every stage is written as Parquet in the shared folder and read again as the next one's
documents, so a lost executor costs a part of one stage only. Stage by stage:

1. quality: documents that the repetition rules reject go.
2. near_dedup: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8).
3. decontaminate: documents that hold a benchmark item go.
4. mix: sources are mixed to their target weights; a row for each document and epoch, with the words taken of it.
5. shard: every row gets a shard of near equal bytes and its slot there, beside the columns of documents.

All but the last return the columns of documents alone; null texts fail the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import written
from anamnesis.llm.decontaminate import keep_clean
from anamnesis.llm.mixing import mixed_documents
from anamnesis.llm.near_dedup import keep_one
from anamnesis.llm.quality import keep_good
from anamnesis.llm.sharding import with_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
#: The network of near-duplicates and the seeded draws of the mix are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
