"""The corpus pipeline: language ID, quality rules, line dedup, MinHash near-dedup and best-fit packing, in this order.

Each stage takes all that its predecessor kept and gives, but for the last, the columns of documents as they came, whatever else is in the table.
Defined cases, of each stage as of its operator: a null or empty text has no language and goes in the first stage; a null doc_id is a document of
its own that no stage drops for its id; rows that repeat a doc_id are judged each by its own text up to near-dedup, where they are one document
and stay or go together; an empty table, or one of which nothing is left, passes through as an empty one. Rows that tie go by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import dealt, small_batches, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least language.REJECT_BELOW of the words' bytes are in their language's spans. The model learns from the rows that are
    not held out; without any labelled row nothing has a language, and nothing is left."""
    small_batches(spark)
    return language.keep_known(dealt(docs), language.fit(language.training_rows(docs)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repeated passages, repeated lines and symbols."""
    small_batches(spark)
    return quality.keep(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many hold, but for the largest doc_id that does."""
    small_batches(spark)
    return line_dedup.deduplicated(docs)


#: Texts of this similarity or more, in per cent, are near-duplicates in the pipeline: the least that a stage on word shingles is to take. The query
#: op5 has its own threshold of 85.
NEAR = 80


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id."""
    small_batches(spark)
    return near_dedup.keep(docs, NEAR)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all documents: one row for each item, and one without a bin for a text without tokens (line dedup may leave such)."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("line_dedup", unique_lines),
    ("near_dedup", one_of_each),
    ("packing", packed),
]

#: A trained model, MinHash and best-fit packing can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
