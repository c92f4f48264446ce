"""Query op4: a mix of all documents by source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import mixing


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).drop("source")


def _seats(rows: str, group: str, ident: str, share: str, seats: str, out: str) -> str:
    """SQL that seats a table's rows; the highest quotients are ranked among all near the last seat."""
    part = f"PARTITION BY {group}" if group else ""
    also = f"{group}, " if group else ""
    match = f"n.{group} IS NOT DISTINCT FROM w.{group} AND " if group else ""
    return f"""(WITH n0 AS (
  SELECT *, sum({share}) OVER ({part}) AS tot, count(*) OVER ({part}) AS cnt FROM {rows}
), n1 AS (
  SELECT *, CASE WHEN tot > 0 THEN floor({share} * {seats} / tot + 0.5)::BIGINT ELSE 0 END AS fst FROM n0
), n2 AS (
  SELECT *, CASE WHEN tot > 0 THEN {seats} - sum(fst) OVER ({part}) ELSE 0 END::BIGINT AS miss FROM n1
), n3 AS (
  SELECT *, CASE WHEN tot > 0 THEN ceil((abs(miss) + cnt) * {share} / tot)::BIGINT ELSE 0 END + 1 AS reach FROM n2
), ks AS (
  SELECT {also}{ident}, miss, {share} AS share, unnest(CASE WHEN miss > 0 THEN range(fst, fst + reach + 1)
    WHEN miss < 0 THEN range(greatest(fst - reach, 0), fst) ELSE [] END) AS k FROM n3
), rk AS (
  SELECT *, row_number() OVER ({part} ORDER BY CASE WHEN miss > 0 THEN -(share / (2 * k + 1)) ELSE share / (2 * k + 1) END, {ident}, k) AS r FROM ks
), won AS (SELECT {also}{ident}, sum(sign(miss))::BIGINT AS more FROM rk WHERE r <= abs(miss) GROUP BY ALL)
SELECT n.*, n.fst + coalesce(w.more, 0) AS {out} FROM n3 n LEFT JOIN won w ON {match}n.{ident} IS NOT DISTINCT FROM w.{ident})"""


def mixing_sql(docs: str = "documents") -> str:
    m, b = mixing.MAX_EPOCHS, mixing.BLOCK_WORDS
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}
), d AS (
  SELECT *, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS digest FROM sized
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {float(m)}::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS tot_size,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS wleft FROM s1
), s3 AS (
  SELECT *, (SELECT arg_min((tot_size - before) / wleft, (cap / weight, source IS NULL, source)) FROM s2 WHERE cap / weight >= (tot_size - before) / wleft) AS level FROM s2
), s4 AS (SELECT source, source_size, n_docs, least(cap, level * weight) AS target FROM s3
), s5 AS (SELECT *, floor(sum(target) OVER () / {b})::BIGINT AS n_blocks FROM s4
), q AS (SELECT source, source_size, n_docs, target, quota FROM {_seats('s5', '', 'source', 'target', 'n_blocks', 'quota')}
), e AS (
  SELECT d.*, q.source_size, q.target, q.quota,
    ('0x' || substr(digest, 1, 8))::BIGINT % ceil(q.n_docs / {mixing.SHARD_DOCS})::BIGINT AS shard
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota FROM e GROUP BY source, shard
), hs AS (SELECT source, shard, shard_size, least(blocks * {b}, shard_size * {m}) AS words FROM {_seats('h', 'source', 'shard', 'shard_size', 'quota', 'blocks')}
), l AS (
  SELECT e.*, hs.shard_size, hs.words, CASE WHEN hs.shard_size > 0 THEN hs.words // hs.shard_size ELSE 0 END AS rounds,
    coalesce(sum(e.size) OVER (PARTITION BY e.source, e.shard ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM e JOIN hs ON e.source IS NOT DISTINCT FROM hs.source AND e.shard = hs.shard
)
SELECT doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(size, words - rounds * shard_size - start)))::BIGINT AS taken
FROM l"""


SQL = {"op4_mixing": mixing_sql()}
QUERIES = {"op4_mixing": op4_mixing}
