"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and returns a DataFrame: the rows of docs that stay, with
the columns of `documents`, or from the last stage the pieces of the sequences. Null and empty texts go through all stages like other texts; rows
without a doc_id are passed on and packed nowhere; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact, jaccard, packing, quality, suffix
from graphloom.llm.common import read, saved
from graphloom.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, taught by all labels and their texts in the table of documents, rejects."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), known=read(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the greatest doc_id stays."""
    return exact.keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles the document with the least doc_id stays."""
    return jaccard.keep_one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a string of 100 bytes covers which also starts earlier."""
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("packing", packed)]

#: A classifier, a suffix order and an optimal packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
