"""Query op5: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import packing
from lexaudit.llm.common import vocabulary


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, vocabulary(packing.VOCABULARY))


SQL: dict[str, str] = {}
QUERIES = {"op5_packing": op5_packing}
