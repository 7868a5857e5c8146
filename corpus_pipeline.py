"""From raw documents to training shards: five stages, each written as Parquet and read again by the next one.

Every stage works on all rows that the one before has kept, and all but the last return the columns of documents.
``run`` writes between stages into the folder that the driver and all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import decontam, langid, mixing, neardup, sharding
from lakequill.llm.common import cut, read_table

#: Similarity of word shingles from which documents are near duplicates.
NEAR = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compression classifier rejects."""
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the lowest id of each group of near copies."""
    return neardup.keep_first(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights."""
    return mixing.apply_mix(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes compacted shards; returns each row's id with its shard."""
    return sharding.placed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: The stages learn, draw and compare texts; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
