"""The corpus pipeline: bad text goes, one of each group of near copies stays, secrets are masked, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import materialise, read_table
from foliant.llm.ngram_join import keep_one
from foliant.llm.packing import pack_documents
from foliant.llm.quality import fit_outside_fold, keep_good
from foliant.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it is fitted on the table's labelled documents outside the held-out fold."""
    return keep_good(docs, fit_outside_fold(docs, read_table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: The classifier and the tokeniser have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
