"""A training corpus from raw documents: language ID, near duplicates, repeated passages, source mix, packed batches.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, written and read again, and returns the columns of
documents; the last returns what packing gives. The stages need models and iterations that SQL can't express, so there is no
ORACLE_SQL; tests/llm/test_pipeline.py holds every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groveline.llm import jaccard, langid, mixing, packing, suffixes
from groveline.llm.common import read, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known go: no letter, or no language near a probability of 0.4."""
    return langid.known(docs, least=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id: five words, a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.Scheme(words=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte goes that a string of 200 bytes covers which stands anywhere else too."""
    return suffixes.deduped(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words by the sources' target weights; a document that the mix takes twice is two rows."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the bucket, batch and place of each row of the mix."""
    return packing.pack(docs, carry=("source",))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing sources", source_mix), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
