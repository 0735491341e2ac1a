"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Documents that the quality classifier rejects go, then all but one of equal texts, then all but one of near duplicates;
what is left is mixed to the sources' target weights and packed into sequences. The rows of the last stage are the
pieces of documents with their places in the sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, jaccard_join, mixing, packing, quality
from plumbline.llm.tables import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among `docs`, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_repeats(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", distinct_groups),
    ("source_mix", mixed_sources),
    ("pattern_packing", packed_sequences),
]

# The classifier's model and the tokenizer have no SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
