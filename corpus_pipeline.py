"""The corpus pipeline: stages that each call one operator, over the whole of what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language_id, pieces, simhash, substrings
from millrace.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id.stage),
    ("simhash_dedup", simhash.stage),
    ("substring_dedup", substrings.stage),
    ("decontamination", decontamination.stage),
    ("sentencepiece", pieces.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
