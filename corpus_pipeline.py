"""The corpus pipeline: five operators in a row over ``documents``, each working on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm import decontamination, exact_dedup, jaccard_join, language, mixing
from tablelens.llm.common import table
from tablelens.session import materialize


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is not clear go."""
    return language.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest id stays."""
    return exact_dedup.without_duplicates(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the smallest id stays."""
    return jaccard_join.one_per_component(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with benchmark passages go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: how many words of each document the mix takes."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", clear_language),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", uncontaminated),
    ("mixing", mixed_sources),
]
#: Compression cannot be put into SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of the documents that all stages keep."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
