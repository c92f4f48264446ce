"""Query op13: all documents transformed for filling in the middle, and rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import fim


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(fim.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = {
    "op13_fill_in_middle": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), g AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {fim.RATE} THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, form, n, array_to_string(units[1:least(c1, c2)], '') AS pre, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
    array_to_string(units[greatest(c1, c2) + 1:n], '') AS suf
  FROM g
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""
}
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
