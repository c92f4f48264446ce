"""Query op9: every page through a legacy archive into WARC files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import warc
from lexaudit.llm.common import shared_path


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS g FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
}
QUERIES = {"op9_warc": op9_warc}
