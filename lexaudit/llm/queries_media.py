"""Query op7: every text as a media column and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import media


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL: dict[str, str] = {}
QUERIES = {"op7_media": op7_media}
