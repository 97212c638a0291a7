"""From documents to shards: five stages, each a corpus operator whose decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registra.llm import common, decontam, langid, mixing, ngram_join, sharding


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are told to be in none of the learned languages go: those without a letter, and those no closer to any language than chance is."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one of the smallest id."""
    return ngram_join.one_of_each_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and their slot in it."""
    return sharding.add_shard(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free), ("mixing", mix), ("sharding", shards)]
#: SQL has no hyperdimensional profiles; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.temporary() as kept:
            done = common.cut(stage(spark, docs, sf_dir), name)
            kept.append(done)
        common.discard(docs)
        docs = done
    return docs
