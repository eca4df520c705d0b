"""The stages of the corpus pipeline, ``(spark, docs, sf_dir) -> DataFrame`` each.

All but the last return rows of ``docs`` with its columns; null and empty texts go through every stage like others (they
count as one text in the deduplications).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm import bpe, decontaminate, exact_dedup, quality, simhash_dedup


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier takes for good (score of 0.5 or more)."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, name="__quality")
    return scored.filter(F.col("__quality") >= 0.5).drop("__quality")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (3-word shingles, 2 bits) the document with the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs, width=3, max_bits=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding them."""
    import public_tokenizers
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                             with_ids=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("exact", exact_copies),
    ("near", near_copies),
    ("decontaminate", without_benchmark),
    ("tokens", encoded),
]
