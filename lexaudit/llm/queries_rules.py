"""Query op3: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import rules
from lexaudit.llm.common import vocabulary


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(rules.VOCABULARY))


SQL: dict[str, str] = {}
QUERIES = {"op3_rules": op3_rules}
