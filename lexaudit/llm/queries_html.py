"""Query op6: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import html


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op6_html": op6_html}
