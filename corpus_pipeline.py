"""From raw documents to tokens: five stages, each one operator of the training-data subpackage.

Toxic documents go, then exact copies, then all but one of each group of near copies; the rest is mixed to the
sources' target weights (a document comes out as often as the mix takes it) and encoded. Each stage reads what its
predecessor wrote.

A null text counts as the empty text everywhere: it is never toxic, all empty texts are one exact copy, none has a near
copy, and the mix takes none, as it has no words. A null source is a source of its own. Rows that repeat a doc_id with
different texts are documents of their own; with equal texts, one stays. An empty table gives an empty result, and extra
columns go along unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ampliform.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from ampliform.llm.common import own_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), states=20_000, memo=50_000)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Hashed features, similarity classes and byte-pair merges are not SQL's; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{own_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
