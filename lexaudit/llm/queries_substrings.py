"""Query op10: repeated 50-byte strings of all documents removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import substrings


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
