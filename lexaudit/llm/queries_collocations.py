"""Query op12: phrase collocations of all documents by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm import collocations as c


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {n} AS words, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS phrase FROM p WHERE len(w) >= {n}" for n in range(1, c.MAX_WORDS + 1)
)
_CUTS = " UNION ALL ".join(
    f"SELECT lang, phrase, words, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS head, array_to_string(w[{k + 1}:], ' ') AS tail FROM c WHERE words > {k}" for k in range(1, c.MAX_WORDS)
)
_INNER = " UNION ALL ".join(
    f"SELECT lang, a, array_to_string(w[{i}:{i + n - 1}], ' ') AS inner_phrase FROM c WHERE words = {longer}" for longer in range(3, c.MAX_WORDS + 1) for n in range(2, longer) for i in range(1, longer - n + 2)
)
SQL = {
    "op12_collocations": rf"""
WITH t AS (
  SELECT coalesce(lang, '{c.NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND f >= {c.MIN_COUNT}
), s AS (
  SELECT cut.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM ({_CUTS}) cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT b.* FROM b LEFT JOIN (SELECT lang, inner_phrase, max(a) AS longer FROM ({_INNER}) GROUP BY ALL) o ON o.lang = b.lang AND o.inner_phrase = b.phrase
  WHERE coalesce(100 * o.longer < {c.SUBSUME} * b.a, true)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= {c.TOP}
"""
}
QUERIES = {"op12_collocations": op12_collocations}
