"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Nulls, ties and empty tables: as each operator defines. Rows
that repeat a doc_id are told apart by their texts in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import decontam, linededup, mixing, neardup, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go."""
    return quality.filter_documents(docs, shared.read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows and of passages of 50 words are cut from the texts; n_chars follows."""
    return linededup.dedup_passages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, shared.read(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, shared.written(stage(spark, docs, sf_dir))
        shared.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The verdict of the trees has no SQL form. tests/llm/test_pipeline.py applies each stage to a planted corpus and checks every
#: stage's decisions; tests/llm hold the operators against brute force.
ORACLE_SQL = None
