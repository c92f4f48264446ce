"""Query op11: ids of all documents by a public byte-level vocabulary, and the texts of the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import bpe
from lexaudit.llm.common import vocabulary


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(bpe.VOCABULARY)
    return bpe.bpe_digest(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)


SQL: dict[str, str] = {}
QUERIES = {"op11_byte_bpe": op11_byte_bpe}
