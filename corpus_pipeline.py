"""From raw documents to shards: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and works on all rows that the stage
before it kept. All but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.durable import written
from lodestone.llm import curriculum_mix, decontaminate, extendible_shards, ngram_jaccard, quality_classifier
from lodestone.sources import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained outside the held-out fold of ``labels``, accepts."""
    return quality_classifier.accepted(docs, quality_classifier.fitted(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_jaccard.deduplicated(docs, n=5, t=80, sub=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``, edited or not."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document as often as its source's target takes it, range-sorted by position."""
    return curriculum_mix.schedule(curriculum_mix.mix(docs, carry=True)).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row of the mix."""
    return extendible_shards.shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharding)]

#: The stages hash, train and align; SQL cannot express them. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
