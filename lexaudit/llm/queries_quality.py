"""Query op1: perplexity of all documents under a model of trusted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import kneser


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return kneser.classify(docs, labels)


SQL: dict[str, str] = {}
QUERIES = {"op1_quality": op1_quality}
