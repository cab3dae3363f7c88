"""A cleaning pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

Quality, then toxicity, then near duplicates, then repeated passages; what is left is packed into sequences of tokens.
All but the last stage return the columns of documents. A stage learns from what the stages before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm import jaccard_join, packing, quality_lm, suffix_dedup, toxicity
from fumiyomi.llm.common import DOCUMENT_COLUMNS, documents, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is within their language's threshold."""
    return quality_lm.keep(docs, _labels(spark, sf_dir)).select(*DOCUMENT_COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't flag."""
    return toxicity.keep(docs, toxicity.fit(toxicity.sample(docs, _labels(spark, sf_dir)))).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.deduplicate(docs).select(*DOCUMENT_COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes that an earlier one has, too."""
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL can express none of the models, nor the search of the last stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
