"""A corpus pipeline of the llm operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laminaspark.llm import dedup, near
from laminaspark.llm.common import read, staged
from laminaspark.llm.packing import pack
from laminaspark.llm.quality import keep_good, train


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from this stage's documents and the table of labels. Null and
    empty texts are scored like any other; without evidence nothing is rejected."""
    return keep_good(docs, train(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return dedup.one_of_each(docs)


def simhash_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their 5-word shingles alike) the document with the smallest doc_id. Null texts
    count as empty, null ids as the smallest; of rows that share an id the one with the smallest digest stays."""
    return near.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact), ("simhash_near_dedup", simhash_near), ("best_fit_packing", packing)]

#: The classifier, SimHash and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
