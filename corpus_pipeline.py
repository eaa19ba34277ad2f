"""The training-corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import stages
from gridloom.llm.common import importable, marked, new_path, release, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = stages.STAGES

#: No SQL: merges of byte pairs, MinHash bands and the learned language filters can't be expressed in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows. What a stage has read and written on its way is removed from
    the shared folder once its result is written."""
    importable(spark)
    docs, start = table(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, start, keep=path)
    return docs
