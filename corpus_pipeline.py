"""Corpus preparation: quality, exact and near copies, source mix, token ids.

Every stage takes what its predecessor kept, as a table with the columns of ``documents``; the last
one returns token counts and digests instead. Stages are written and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paragauge.llm import bpe_replay, jaccard_join, mixing, rule_ensemble, trie_dedup
from paragauge.session import scratch_path

#: In the mix no source is read more often than this; every row is read at least once.
REPETITIONS = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. It learns from ``labels``, never from the
    held-out fold; without labels that can be learnt from nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rule_ensemble.keep(docs, rule_ensemble.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id."""
    return trie_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the flattest temperature under the repetition limit; the largest source
    is read once, the others in part twice."""
    return mixing.mix(docs, repetitions=REPETITIONS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix the number of tokens, and digests of the ids and of what they decode to."""
    return bpe_replay.encode(docs, ids=False)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", encode),
]

#: A learned model and merge replay cannot be stated in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{i}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
