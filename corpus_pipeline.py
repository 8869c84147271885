"""Corpus pipeline over ``documents``: quality rules, near-duplicate join, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conflictlake.llm import mixing, ngram_join, packing, quality
from conflictlake.llm.common import settled, table
from conflictlake.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands; rejected documents go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, 5, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1; a document stays as often as the mix takes it."""
    return mixing.mixed_documents(docs, [5, 2, 1])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of every document into 1024-token sequences."""
    return packing.pack(packing.token_pieces(docs, tokenizer()))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mix), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the mixed, deduplicated, filtered documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = settled(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
