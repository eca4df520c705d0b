"""The corpus pipeline: STAGES in order, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markscope.llm.common import written
from markscope.llm.stages import STAGES

#: The classifier's scores can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table, reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
