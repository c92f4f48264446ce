"""Query op8: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import near


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near.near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


SQL: dict[str, str] = {}
QUERIES = {"op8_near_dedup": op8_near_dedup}
