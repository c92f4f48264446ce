"""Queries of reviewer records, selection, retrieval, benchmarks and files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import text as T
from lexaudit.functions.diff import diff
from lexaudit.operators import benchmarks, reports, retrieval, review, selection
from lexaudit.plans.queries import _REC, _records, query, usable
from lexaudit.session import scratch, table
from lexaudit.sources import io

# ---------------------------------------------------------------- reviewer records


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    yes = lambda e: F.get(F.array(F.lit("yes"), F.lit(" NO "), F.lit("Partially")), (e % 3).cast("int"))
    values = {
        "No.": F.concat((k + 1).cast("string"), F.when(k % 2 == 0, ".0").otherwise("")), "Case reference": F.concat(F.lit("case"), (k % 100).cast("string")), "Legal statement for review": F.concat(F.lit("  Rule "), (k % 7).cast("string"), F.lit("  HOLDS. ")),
        "Provision / legal reference mentioned": F.concat(F.lit("Section "), (k % 5).cast("string"), F.lit(" of the Trade Act, 1950")),
        "Is the legal statement correct? (Yes / No/ Partially)": yes(k), "Is the legal reference correct?  (Yes / No/ Partially)": yes(k + 1),
        "Correction or clarification (if required)": F.when(k % 4 == 0, F.concat(F.lit("see row "), (k % 9).cast("string"))), "Legal authority supporting your assessment": F.when(k % 6 == 0, F.lit("as No. 12")),
    }
    return o.select(*[v.alias(h) for h, v in values.items()], k.alias("row_ord"))


_ANN = """an AS (SELECT 'LR-' || CASE WHEN o_orderkey + 1 > 9999 THEN substr((o_orderkey + 1)::VARCHAR, 1, 4) ELSE lpad((o_orderkey + 1)::VARCHAR, 4, '0') END AS annotation_id, o_orderkey + 1 AS source_row_number, o_orderkey AS k, 'case' || o_orderkey % 100 AS case_reference,
  ['Yes', 'No', 'Partially'][o_orderkey % 3 + 1] AS statement_correctness, ['Yes', 'No', 'Partially'][(o_orderkey + 1) % 3 + 1] AS reference_correctness FROM orders)"""


@query(f"WITH {_ANN} SELECT annotation_id, source_row_number, k + 2 AS source_excel_row, case_reference, statement_correctness, reference_correctness FROM an")
def review_import(spark: SparkSession, d: str) -> DataFrame:
    """A sheet's rows as typed annotations: labels, whole numbers, required fields."""
    return review.import_rows(_sheet(spark, d)).select("annotation_id", "source_row_number", "source_excel_row", "case_reference", "statement_correctness", "reference_correctness")


@query(f"WITH {_ANN} SELECT source_row_number, 'correction_or_clarification' AS field, k % 9 AS referenced_source_row_number FROM an WHERE k % 4 = 0 UNION ALL SELECT source_row_number, 'supporting_legal_authority', 12 FROM an WHERE k % 6 = 0")
def review_cross_references(spark: SparkSession, d: str) -> DataFrame:
    return review.cross_references(review.import_rows(_sheet(spark, d)), "source_row_number")


def _model_claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each line, as if read from two models' files."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.concat(F.lit("case"), (F.col("l_orderkey") % 100).cast("string")).alias("document_id"), F.concat(F.lit("c"), (p % 50).cast("string")).alias("claim_id"), F.concat(F.lit("f"), (s % 3).cast("string")).alias("source_file"),
        F.concat(F.lit("f"), (s % 3).cast("string")).alias("source_ord"), F.concat(F.lit("rule "), (p % 7).cast("string"), F.lit(" holds.")).alias("claim_text"), F.lit("").alias("assertion_text"),
        F.when(p % 11 == 0, "Article").otherwise("Section").alias("provision_type"), (p % 5).cast("string").alias("provision_number"), F.when(p % 4 == 0, "the Other Act, 1960").otherwise("the Trade Act, 1950").alias("act_raw"),
        F.when(p % 4 == 0, "other act 1960").otherwise("trade act 1950").alias("act_norm"), F.when(s % 2 == 0, F.lit("E1")).alias("evidence_id"), F.lit("t").alias("evidence_text"),
        F.when(s % 3 == 0, "fuzzy").otherwise("exact_normalized").alias("evidence_match_method"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("verdict"), F.lit("m").alias("verifier_model"),
    )


_MC = """mc AS (SELECT DISTINCT 'case' || l_orderkey % 100 AS doc, 'c' || l_partkey % 50 AS cid, 'f' || l_suppkey % 3 AS f, 'rule ' || l_partkey % 7 || ' holds.' AS ct, CASE WHEN l_partkey % 11 = 0 THEN 'article' ELSE 'section' END AS kind, (l_partkey % 5)::VARCHAR AS num,
  CASE WHEN l_partkey % 4 = 0 THEN 'other act 1960' ELSE 'trade act 1950' END AS act, CASE WHEN l_suppkey % 2 = 0 THEN 'E1' END AS ev, CASE WHEN l_suppkey % 3 = 0 THEN 'fuzzy' ELSE 'exact_normalized' END AS m, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS v FROM lineitem),
mg AS (SELECT doc, cid, ct, kind, num, act, CASE WHEN count(DISTINCT coalesce(v, chr(1))) > 1 THEN 'VARIANT' ELSE min(v) END AS verdict, CASE WHEN count(DISTINCT m) > 1 THEN 'VARIANT' ELSE min(m) END AS method, string_agg(DISTINCT f, ',' ORDER BY f) AS files, min(ev) AS ev FROM mc GROUP BY ALL)"""


@query(f"WITH {_MC} SELECT doc AS document_id, cid AS claim_id, ct AS claim_text, kind, num AS provision_number, act AS act_norm, verdict, method AS evidence_match_method, files, ev AS evidence_id FROM mg")
def variant_merge(spark: SparkSession, d: str) -> DataFrame:
    """Model claims of several files as one; conflicts are variants, nulls a value."""
    m = review.merge_variants(_model_claims(spark, d))
    return m.select("document_id", "claim_id", "claim_text", F.col("k_type").alias("kind"), "provision_number", "act_norm", "verdict", "evidence_match_method", F.array_join("source_files", ",").alias("files"), "evidence_id")


_ALIGN = f"""{_ANN}, {_MC}, j AS (SELECT an.*, 'rule ' || an.k % 7 || ' holds.' AS st, (an.k % 5)::VARCHAR AS num0 FROM an),
cs AS (SELECT doc, count(*) AS nc FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_returnflag, 'case' || l_orderkey % 100 AS doc FROM lineitem) GROUP BY 1),
al AS (SELECT source_row_number, count(mg.doc) AS n_statement, count(DISTINCT (mg.cid, mg.kind, mg.num, mg.act)) FILTER (WHERE mg.kind = 'section' AND mg.num = num0 AND mg.act = 'trade act 1950') AS n_aligned,
  count(DISTINCT (mg.cid, mg.kind, mg.num, mg.act)) FILTER (WHERE mg.kind = 'article' AND mg.num = num0 AND mg.act = 'trade act 1950') AS n_typed, coalesce(bool_or(mg.kind = 'section' AND mg.num = num0), false) AS any_, any_value(cs.nc) AS nc
  FROM j LEFT JOIN mg ON mg.doc = case_reference AND mg.ct = st LEFT JOIN cs ON cs.doc = case_reference GROUP BY 1)"""


@query(f"""WITH {_ALIGN} SELECT source_row_number, n_statement, n_aligned, n_typed, CASE WHEN n_aligned = 0 AND n_typed = 0 THEN CASE WHEN n_statement = 0 THEN 'no_exact_statement_match' WHEN NOT any_ THEN 'no_provision_identifier_or_reference_text_match' ELSE 'act_name_incompatible_or_unresolved' END END AS unmatched_reason FROM al""")
def review_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Annotations against model claims: statement, typed reference and act."""
    a = review.align(review.import_rows(_sheet(spark, d)), _model_claims(spark, d))
    return a.select(
        "source_row_number", F.col("num_distinct_statement_matches").alias("n_statement"), F.col("num_reference_aligned_matches").alias("n_aligned"), F.col("num_typed_provision_mismatch_matches").alias("n_typed"), "unmatched_reason"
    )


@query(f"""WITH {_ALIGN} SELECT count(*) AS n_rows, count(nc) AS rows_with_case_found, count(*) FILTER (WHERE n_statement > 0) AS rows_with_exact_statement_match, count(*) FILTER (WHERE n_aligned > 0) AS rows_with_reference_match,
count(*) FILTER (WHERE n_aligned = 1) AS rows_with_unique_alignment, count(*) FILTER (WHERE n_aligned > 1) AS rows_with_ambiguous_alignment, count(*) FILTER (WHERE n_typed > 0) AS rows_with_typed_mismatch, round(count(*) FILTER (WHERE n_statement > 0) / count(*)::DOUBLE, 6) AS statement_match_rate FROM al""")
def alignment_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = review.alignment_coverage(review.align(review.import_rows(_sheet(spark, d)), _model_claims(spark, d)))
    return c.withColumn("statement_match_rate", F.round("statement_match_rate", 6))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN 'missing_audit' WHEN o_custkey % 3 = 0 THEN 'no_exact_statement_match' WHEN o_custkey % 4 <> 1 THEN 'alignment_not_unique' WHEN o_custkey % 7 <> 1 THEN 'candidates_not_unique' END AS reason FROM orders) GROUP BY 1""")
def feature_exclusions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, d, "orders").groupBy(review.feature_exclusion(k % 5 != 0, k % 3 != 0, k % 4, k % 7).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_REFS = [
    ("Section 5 of the Arms Act, 1959", "of the arms act", "The Arms Act, 1959", "mismatch"), ("Section 5 of the Arms Act", "of the arms act", "Explosives Act, 1884", "mismatch"), ("Section 302 IPC", "ipc", "Indian Penal Code, 1860", "match"),
    ("Article 21", "", "Constitution of India", "unspecified"), ("same Act", "", "The Arms Act, 1959", "unspecified"), ("sub-section 2 of Section 9, Customs Act (as amended)", "sub of customs act", "the Customs Act, 1962", "mismatch"),
    ("the Trade Act, 1950", "trade act", "Trade Act", "match"),
]


@query(f"SELECT p_partkey, act, matched FROM part JOIN (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{m}{chr(39)})' for i, (_, a, _, m) in enumerate(_REFS))}) v(i, act, matched) ON p_partkey % {len(_REFS)} = i")
def review_references(spark: SparkSession, d: str) -> DataFrame:
    """The act of a reference, and whether a candidate's act is it."""
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in _REFS]), (F.col("p_partkey") % len(_REFS)).cast("int"))
    act = review.reference_act(pick(0))
    return table(spark, d, "part").select("p_partkey", act.alias("act"), review.act_match(act, pick(2)).alias("matched"))


@query("""SELECT o_orderkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS reference, lower(regexp_replace('(' || o_orderpriority || ')', '[^A-Za-z0-9()]', '', 'g')) AS number, lower('a b ' || o_orderstatus) AS plain FROM orders""")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", T.normal_reference(p).alias("reference"), T.normal_number(F.concat(F.lit("("), p, F.lit(")"))).alias("number"), T.normal_text(F.concat(F.lit(" A \t b  "), "o_orderstatus")).alias("plain"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return review.joined_one_to_one(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_totalprice"), "o_orderkey")


# ---------------------------------------------------------------- selection


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''), ' ')) >= 200")
def usable_texts(spark: SparkSession, d: str) -> DataFrame:
    return selection.usable_text(table(spark, d, "documents"), "text", 200).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    return selection.first_of_text(table(spark, d, "documents"), "text", "doc_id").select("doc_id", F.md5("text").alias("h"))


@query("""SELECT o_custkey AS document_id, o_orderkey AS file_ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10 DESC, o_orderkey % 3, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 10).alias("score"), (F.col("o_orderkey") % 3).alias("n_raw_citation_keys"), F.col("o_orderkey").alias("file_ord"))
    return selection.best_variant(rows).select("document_id", "file_ord")


_MATCHED = """m AS (SELECT l_orderkey AS doc, CASE l_partkey % 4 WHEN 0 THEN 'no_evidence' WHEN 1 THEN 'fuzzy' ELSE 'exact_normalized' END AS mm, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'code of criminal procedure 1973' ELSE 'act ' || l_suppkey % 5 END AS act, (l_partkey % 6)::VARCHAR AS num FROM lineitem),
k AS (SELECT doc, count(*) FILTER (WHERE mm = 'exact_normalized') AS ex, count(*) FILTER (WHERE mm = 'fuzzy') AS fz, list_distinct(list((act, num)) FILTER (WHERE mm <> 'no_evidence')) AS pairs, count(*) FILTER (WHERE mm <> 'no_evidence' AND act NOT LIKE 'code of criminal%') AS sub, count(*) FILTER (WHERE mm <> 'no_evidence' AND act LIKE 'code of criminal%') AS pro FROM m GROUP BY 1),
o AS (SELECT *, 3 * ex + 2 * fz + 2 * coalesce(len(pairs), 0) + sub AS score, row_number() OVER (ORDER BY 3 * ex + 2 * fz + 2 * coalesce(len(pairs), 0) + sub DESC, coalesce(len(pairs), 0) DESC, doc) AS r FROM k),
f AS (SELECT DISTINCT min(r) AS r FROM (SELECT r, unnest(pairs) AS p FROM o) GROUP BY p), t AS (SELECT * FROM (SELECT o.*, row_number() OVER (ORDER BY f.r IS NULL, o.r) AS place FROM o LEFT JOIN f ON o.r = f.r) WHERE place <= 30)"""


@query(f"""WITH {_MATCHED} SELECT count(*) AS n, sum(ex)::BIGINT AS n_exact, sum(fz)::BIGINT AS n_fuzzy, count(*) FILTER (WHERE sub = 0 AND pro > 0) AS n_procedural_only, (SELECT count(DISTINCT p) FROM (SELECT unnest(pairs) AS p FROM t)) AS n_pairs, (SELECT count(DISTINCT p[1]) FROM (SELECT unnest(pairs) AS p FROM t)) AS n_acts FROM t""")
def top_batch(spark: SparkSession, d: str) -> DataFrame:
    """What the first 30 cases of the diversity-first order cover."""
    li = table(spark, d, "lineitem")
    method = F.when(F.col("l_partkey") % 4 == 0, "no_evidence").when(F.col("l_partkey") % 4 == 1, "fuzzy").otherwise("exact_normalized")
    act = F.when(F.col("l_partkey") % 4 != 0, F.when(F.col("l_suppkey") % 3 == 0, "code of criminal procedure 1973").otherwise(F.concat(F.lit("act "), (F.col("l_suppkey") % 5).cast("string"))))
    m = li.select(F.col("l_orderkey").alias("document_id"), method.alias("match_method"), act.alias("act_norm"), (F.col("l_partkey") % 6).cast("string").alias("provision_number"))
    return selection.batch_summary(selection.top_cases(selection.scorecard(m), 30))


@query("SELECT 40::BIGINT AS n, 40::BIGINT AS n_keys, 0::BIGINT AS n_unknown")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Forty customers drawn without replacement; the same whenever it is asked for."""
    c = table(spark, d, "customer")
    one, two = (selection.seeded_sample(c, 40, 42, "c_custkey").select("c_custkey", "draw") for _ in range(2))
    strange = one.join(two.select(F.col("c_custkey").alias("k"), F.col("draw").alias("w")), (F.col("c_custkey") == F.col("k")) & (F.col("draw") == F.col("w")), "left_anti")
    return one.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_keys")).join(strange.agg(F.count(F.lit(1)).alias("n_unknown")))


# ---------------------------------------------------------------- retrieval

_WORDS = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z'']+')), lambda x: length(x) > 2 AND x NOT IN ('the','of','and','in','for','to','a','an','this','that','act','constitution','india'))"
_BM25 = f"""dt AS (SELECT doc, {_WORDS.format('doc')} AS ts FROM (SELECT DISTINCT p_name || ' ' || lower(p_type) AS doc FROM part)), n AS (SELECT count(*) AS n, avg(len(ts)) AS ml FROM dt), t AS (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM dt), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df CROSS JOIN n), i1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
w AS (SELECT doc, t.term, idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / ml)) AS weight FROM t JOIN i1 ON t.term = i1.term CROSS JOIN n), sf AS (SELECT doc, sum(weight) AS self FROM w GROUP BY 1),
q AS (SELECT query, unnest({_WORDS.format('query')}) AS term FROM (SELECT DISTINCT p_name AS query FROM part)), s AS (SELECT query, w.doc, sum(weight) AS score FROM q JOIN w ON q.term = w.term GROUP BY 1, 2)"""


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("query")).distinct(), retrieval.bm25_index(p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("act_norm")))


@query(f"WITH {_BM25} SELECT query, s.doc, round(CASE WHEN self > 0 THEN least(1.0, score / self) ELSE 0 END, 6) AS similarity FROM s JOIN sf ON s.doc = sf.doc")
def bm25_similarity(spark: SparkSession, d: str) -> DataFrame:
    q, index = _index(spark, d)
    return retrieval.bm25_similarity(q, index).select("query", "doc", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_BM25}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS ar FROM s) WHERE ar <= 3)
SELECT query, p_partkey, rank::INTEGER AS rank FROM (SELECT a.query, p_partkey, row_number() OVER (PARTITION BY a.query ORDER BY ar, p_partkey) AS rank FROM a JOIN part ON a.doc = p_name || ' ' || lower(p_type)) WHERE rank <= 3""")
def act_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Records of the acts most like a name."""
    q, index = _index(spark, d)
    records = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("pool_ord"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("act_norm"))
    scored = retrieval.bm25_scores(q, index).withColumn("score", F.round("score", 6))
    return retrieval.suggest(scored, records, 3).select("query", "p_partkey", "rank")


_ACTS = [
    "indian evidence act 1872", "indian penal code 1860", "code of criminal procedure 1973", "code of civil procedure 1908", "prevention of corruption act 1947", "prevention of food adulteration act 1954", "arbitration and conciliation act 1996",
    "arbitration act 1940", "transfer of property act 1882", "negotiable instruments act 1881", "industrial disputes act 1947", "land acquisition act 1894", "limitation act 1963", "customs act 1962", "income tax act 1961", "income tax rules 1962",
    "essential commodities act 1955", "representation of the people act 1951", "general clauses act 1897", "arms act 1959",
]
_PAIRS = ", ".join(f"('{q}', '{p}', {ok})" for ok, rows in (("true", retrieval.SAME_ACT), ("false", retrieval.OTHER_ACT)) for q, p in rows)
_ALIAS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ALIASES.items()) + " ELSE {0} END"


@query(f"""WITH acts AS (SELECT unnest({_ACTS!r}) AS doc), pr AS (SELECT raw, ok, min(doc) AS doc FROM (VALUES {_PAIRS}) v(raw, part, ok) JOIN acts ON contains(doc, part) GROUP BY raw, part, ok),
n0 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '^the\\s+', ''), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS nq FROM pr), n1 AS (SELECT *, {_ALIAS.format('nq')} AS query FROM n0),
j AS (SELECT *, {_WORDS.format('query')} AS a, {_WORDS.format('doc')} AS b FROM n1), s AS (SELECT ok, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.8 AS hit FROM j)
SELECT 'jaccard' AS method, count(*) FILTER (WHERE ok) AS n_positive, count(*) FILTER (WHERE ok AND hit) AS accepted_right, count(*) FILTER (WHERE NOT ok) AS n_negative, count(*) FILTER (WHERE NOT ok AND NOT hit) AS rejected_right FROM s""")
def name_pair_report(spark: SparkSession, d: str) -> DataFrame:
    """How word overlap accepts names of the same act and rejects those of others."""
    acts = spark.createDataFrame([(a,) for a in _ACTS], "act_norm string")
    pairs = retrieval.pair_similarities(retrieval.name_pairs(acts), retrieval.bm25_index(acts))
    return retrieval.method_report(pairs).filter("method = 'jaccard'")


# ---------------------------------------------------------------- benchmarks

_CITE = "'Section ' || p_size || ' of ' || p_brand"
_LOW = "'whoever' || substr(t, 8)"
_PARA = "'Any person who' || substr(replace(replace(t, 'shall be punished with', 'is liable to punishment of'), 'may extend to', 'may go up to'), 8)"
_NEG = "replace(t, 'shall be punished with', 'shall not be punished with')"
_RULES = "whoever_to_any_person_who|punished_with_to_liable_to_punishment_of|may_extend_to_to_may_go_up_to"
_PARTNER = """w0 AS (SELECT p_partkey, n, t, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS ws FROM r),
x0 AS (SELECT a.p_partkey, b.p_partkey AS o, b.t AS ot, s.i FROM w0 a CROSS JOIN (SELECT unnest([17,23,29,31,37,41,43,47,53]) AS s, generate_subscripts([17,23,29,31,37,41,43,47,53], 1) AS i) s JOIN w0 b ON (a.p_partkey + s.s) % a.n = b.p_partkey
  WHERE a.p_partkey <> b.p_partkey AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE < 0.35), pt AS (SELECT p_partkey, arg_min(o, i) AS o, arg_min(ot, i) AS ot FROM x0 GROUP BY 1)"""
_ITEM = f"""WITH {_REC}, {_PARTNER}, b AS (SELECT r.*, {_CITE} AS c, {_PARA} AS para, {_NEG} AS neg, pt.o, pt.ot FROM r LEFT JOIN pt USING (p_partkey)), i AS (
SELECT p_partkey, 'E1_verbatim' AS condition, t AS hypothesis, 'ENTAILED' AS expected_label, 'verbatim_canonical' AS rules FROM b
UNION ALL SELECT p_partkey, 'E2_verbatim_attributed', 'According to ' || c || ', ' || {_LOW}, 'ENTAILED', 'verbatim_canonical|attribution_prefix' FROM b
UNION ALL SELECT p_partkey, 'E3_paraphrase_bare', para, 'ENTAILED', '{_RULES}' FROM b
UNION ALL SELECT p_partkey, 'E4_paraphrase_attributed', 'According to ' || c || ', a' || substr(para, 2), 'ENTAILED', '{_RULES}|attribution_prefix' FROM b
UNION ALL SELECT p_partkey, 'C1_negated_bare', neg, 'CONTRADICTED', 'punishment_negated' FROM b
UNION ALL SELECT p_partkey, 'C2_negated_attributed', 'According to ' || c || ', w' || substr(neg, 2), 'CONTRADICTED', 'punishment_negated|attribution_prefix' FROM b
UNION ALL SELECT p_partkey, 'N1_other_provision', ot, 'NOT_ENOUGH_INFORMATION', 'verbatim_canonical_of_other_provision:K' || o FROM b WHERE o IS NOT NULL
UNION ALL SELECT p_partkey, 'N2_procedural_addition', substr(t, 1, length(t) - 1) || '{benchmarks.ADDED_DUTY}', 'NOT_ENOUGH_INFORMATION', 'canonical_plus_extraneous_procedural_condition' FROM b)"""


@query(f"{_ITEM} SELECT 'cb_' || substr(sha1('K' || p_partkey), 1, 8) || '_' || condition AS benchmark_id, 'K' || p_partkey AS evidence_key, condition, hypothesis, expected_label, rules FROM i")
def controlled_benchmark(spark: SparkSession, d: str) -> DataFrame:
    items = benchmarks.controlled(_records(spark, d))[0]
    return items.select("benchmark_id", "evidence_key", "condition", "hypothesis", "expected_label", F.array_join("construction_rules", "|").alias("rules"))


@query(f"{_ITEM} SELECT substr(sha256('cb_' || substr(sha1('K' || p_partkey), 1, 8) || '_' || condition), 1, 12) AS item_id, hypothesis, NULL::VARCHAR AS annotator_label FROM i")
def annotation_export(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.annotation_export(benchmarks.controlled(_records(spark, d))[0]).select("item_id", "hypothesis", "annotator_label")


@query(f"""WITH {_REC}, p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty hypothesis' WHEN 1 THEN 'double-negation artifact' WHEN 2 THEN 'contradiction identical to source' WHEN 3 THEN 'attribution factor and prefix disagree' END AS problem FROM r)
SELECT 'b' || p_partkey AS benchmark_id, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT 'b' || p_partkey, 'hypothesis not lexically tied to canonical text' FROM p WHERE p_partkey % 5 = 0""")
def benchmark_problems(spark: SparkSession, d: str) -> DataFrame:
    """Broken items, each found by its rule."""
    k, t = F.col("pool_ord") % 5, F.col("canonical_text")
    said = F.when(k == 0, "").when(k == 1, F.replace(t, F.lit("shall be"), F.lit("shall not not be"))).when(k == 3, F.concat(F.lit("According to it, "), t)).otherwise(t)
    items = _records(spark, d).select(
        F.concat(F.lit("b"), F.col("pool_ord").cast("string")).alias("benchmark_id"), said.alias("hypothesis"), t.alias("evidence_text"), F.when(k == 2, "C1_negated_bare").otherwise("E1_verbatim").alias("condition"), F.lit(False).alias("factor_attribution")
    )
    return benchmarks.violations(items)


@query(f"""WITH {_REC} SELECT 'bench_' || substr(sha1('K' || p_partkey), 1, 8) || '_' || unnest(['entailed', 'contradicted', 'nei']) AS benchmark_id, unnest(['ENTAILED', 'CONTRADICTED', 'NOT_ENOUGH_INFORMATION']) AS expected_label,
unnest(['According to ' || {_CITE} || ', ' || t, {_CITE} || ' provides that ' || replace(t, 'shall be punished with', 'is completely exempt from punishment and cannot be penalized for'), {_CITE} || '{benchmarks.FIRST_NEI}']) AS hypothesis FROM r""")
def first_edition(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.first_edition(_records(spark, d)).select("benchmark_id", "expected_label", "hypothesis")


_FIRST = [
    ("He shall not go.", "He shall at all times go."), ("He shall be punished with death and shall also be liable to fine.", "He is completely exempt from punishment and cannot be penalized for death and shall not be subject to any fine."),
    ("It shall have powers.", "It has no power or authoritys."), ("Shall it? It shall.", "Shall not it? It shall not."), ("He may go.", "He shall under no circumstances go."), ("Nothing more is said about anything here.", "This provision has been completely repealed and imposes no legal effect whatsoever regarding Nothing more is said about any."),
]


@query("SELECT p_partkey, 'Section 1 of A provides that ' || text AS hypothesis FROM part JOIN (VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_FIRST)) + f") v(i, text) ON p_partkey % {len(_FIRST)} = i")
def first_edition_rules(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(a) for a, _ in _FIRST]), (F.col("p_partkey") % len(_FIRST)).cast("int"))
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("dataset_citation_key"), text.alias("canonical_text"), F.lit("Section").alias("provision_type"), F.lit("1").alias("provision_number"), F.lit("A").alias("act"))
    items = benchmarks.first_edition(e).filter("expected_label = 'CONTRADICTED'")
    return items.select(F.col("evidence_key").cast("long").alias("p_partkey"), "hypothesis")


@functools.cache
def _rewrites() -> list[tuple[str, str, str]]:
    """A sentence for each rewriting rule, and what becomes of it, worked out from the rule's words alone."""
    out = []
    for name, pattern, new in benchmarks.PARAPHRASES:
        words = pattern.replace(r"\b", "")
        out.append((f"Thus {words} it.", f"Thus {new} it.", name))
    return out


#: Rules whose words hold another rule's words are changed by that rule first.
_FIXED = {"shall also be liable to fine": "is also liable to a fine"}


@query("SELECT p_partkey, changed FROM part JOIN (VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, b, _) in enumerate(_rewrites())) + f") v(i, changed) ON p_partkey % {len(_rewrites())} = i")
def paraphrase_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every paraphrase rule, on a sentence of its own."""
    text = F.get(F.array(*[F.lit(a) for a, _, _ in _rewrites()]), (F.col("p_partkey") % len(_rewrites())).cast("int"))
    return table(spark, d, "part").select("p_partkey", benchmarks.paraphrased(text)["text"].alias("changed"))


_DENIED = [(f"Thus he {p.replace(chr(92) + 'b', '')} x and y.", f"Thus he {new} x and y.", n) for n, p, new in benchmarks.NEGATIONS] + [("Nothing is said.", "It is not the case that nothing is said.", benchmarks.FALLBACK)]


@query("SELECT p_partkey, changed, rule FROM part JOIN (VALUES " + ", ".join(f"({i}, '{b}', '{n}')" for i, (_, b, n) in enumerate(_DENIED)) + f") v(i, changed, rule) ON p_partkey % {len(_DENIED)} = i")
def negation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every negation rule, on a sentence of its own."""
    text = F.get(F.array(*[F.lit(a) for a, _, _ in _DENIED]), (F.col("p_partkey") % len(_DENIED)).cast("int"))
    n = benchmarks.negated(text)
    return table(spark, d, "part").select("p_partkey", n["text"].alias("changed"), F.array_join(n["rules"], "|").alias("rule"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Section' WHEN o_orderkey % 3 = 1 THEN 'Article' END AS provision_type, CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 9)::VARCHAR || '(1)' END AS provision_number, CASE WHEN o_orderkey % 3 < 2 THEN 'The Act in Force' END AS act FROM orders""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    ident = F.concat(F.when(k == 0, "Section").when(k == 1, "Article").otherwise("Order"), F.lit(" "), (F.col("o_custkey") % 9).cast("string"), F.lit("(1) in The Act in Force"))
    return table(spark, d, "orders").select("o_orderkey", benchmarks.evidence_id_parts(ident).alias("e")).select("o_orderkey", "e.*")


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 5 = 4 THEN 'INVALID' WHEN p_partkey % 5 = 3 THEN 'VERIFIED_CONTENT' ELSE 'VERIFIED_EXACT' END AS v, p_brand FROM part)
SELECT (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT v, count(*) AS n FROM a GROUP BY 1)) AS by_verdict, count(*) AS n_audited, count(*) FILTER (WHERE v <> 'INVALID') AS n_usable, count(DISTINCT lower(p_brand)) FILTER (WHERE v <> 'INVALID') AS n_acts, true AS reconciles FROM a""")
def corpus_composition(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    verdict = F.when(F.col("p_partkey") % 5 == 4, "INVALID").when(F.col("p_partkey") % 5 == 3, "VERIFIED_CONTENT").otherwise("VERIFIED_EXACT")
    audit = p.select(verdict.alias("audit_verdict"), F.lower("p_brand").alias("act_norm"))
    c = reports.corpus_composition(audit, audit.filter(F.col("audit_verdict").isin(*S.USABLE)))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("by_verdict")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return c.select(listed.alias("by_verdict"), "n_audited", "n_usable", "n_acts", "reconciles")


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, md5(regexp_replace(a, '\\s+', ' ', 'g')) AS old, md5(regexp_replace(b, '\\s+', ' ', 'g')) AS new, true AS merged FROM c WHERE b IS NOT NULL""")
def word_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Every turn against the next: both texts read back from the segments, which alternate in kind."""
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    pairs = c.withColumn("next", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    s = pairs.select("conv_id", "turn", diff(F.col("text"), F.col("next")).alias("s"))
    side = lambda kind: F.md5(F.regexp_replace(F.array_join(F.transform(F.filter("s", lambda x: x["type"].isin("same", kind)), lambda x: x["text"]), " "), r"(?U)\s+", " "))
    kinds = F.transform("s", lambda x: x["type"])
    rest = F.greatest(F.size(kinds) - 1, F.lit(0))
    merged = F.forall(F.zip_with(F.slice(kinds, 1, rest), F.slice(kinds, 2, rest), lambda x, y: x != y), lambda differ: differ)
    return s.select("conv_id", "turn", side("removed").alias("old"), side("added").alias("new"), merged.alias("merged"))


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws, count(*) OVER () AS n FROM benchmark), s AS (SELECT unnest([1, 2, 3, 5, 8, 13]) AS s)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws)))::DOUBLE, 6) AS jaccard FROM b x CROSS JOIN s JOIN b y ON y.item_id = (x.item_id + s) % x.n WHERE len(x.ws) > 0 AND len(y.ws) > 0""")
def benchmark_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of every benchmark item with six others."""
    b = table(spark, d, "benchmark").select("item_id", benchmarks.words(F.col("text")).alias("ws"))
    n = b.count()
    x = b.withColumn("step", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3, 5, 8, 13)]))).withColumn("at", (F.col("item_id") + F.col("step")) % max(1, n))
    y = b.select(F.col("item_id").alias("b"), F.col("ws").alias("vs"))
    return x.join(y, F.col("at") == F.col("b")).filter((F.size("ws") > 0) & (F.size("vs") > 0)).select(F.col("item_id").alias("a"), "b", F.round(T.token_overlap(F.col("ws"), F.col("vs")), 6).alias("jaccard"))


# ---------------------------------------------------------------- files: written to the shared folder, read back


@query("""SELECT 'K' || p_partkey AS dataset_citation_key, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 5 <> 3 THEN 'new ' || p_name ELSE p_name END AS canonical_text FROM part WHERE p_partkey % 5 <> 4 OR (p_partkey % 6 = 0 AND p_partkey % 5 <> 3)""")
def evidence_files(spark: SparkSession, d: str) -> DataFrame:
    """Evidence written as JSON lines and read with a second corpus laid over it."""
    p, at = table(spark, d, "part"), scratch(spark, "evidence")
    key = F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("dataset_citation_key")
    row = lambda text: (key, F.col("p_brand").alias("act"), F.lit("Section").alias("provision_type"), F.col("p_size").cast("string").alias("provision_number"), text.alias("canonical_text"))
    io.write_jsonl(p.select(*row(F.col("p_name"))), f"{at}/a")
    io.write_jsonl(p.select(key, F.when(F.col("p_partkey") % 5 == 4, "INVALID").otherwise("VERIFIED_EXACT").alias("audit_verdict")), f"{at}/b")
    extra = p.filter("p_partkey % 6 = 0")
    io.write_jsonl(extra.select(*row(F.concat(F.lit("new "), "p_name"))), f"{at}/c")
    io.write_jsonl(extra.select(key, F.when(F.col("p_partkey") % 5 == 3, "UNRESOLVED").otherwise("VERIFIED_CONTENT").alias("audit_verdict")), f"{at}/d")
    return io.read_evidence(spark, f"{at}/a", f"{at}/b", (f"{at}/c", f"{at}/d"), True).select("dataset_citation_key", "canonical_text")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment || ', \"x\"' AS segment FROM customer")
def sheet_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as CSV with a header and read as a sheet's."""
    at = scratch(spark, "sheet") + "/s.csv"
    io.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "x"')).alias("segment")), at)
    return io.read_sheet(spark, at).select("c_custkey", "c_name", "segment")


@query("SELECT 'case' || l_orderkey AS document_id, 'c' || l_linenumber AS claim_id, 'Rule ' || l_partkey AS claim_text, '' AS assertion_text, 'Section' AS provision_type, l_suppkey::VARCHAR AS provision_number FROM lineitem")
def claim_files(spark: SparkSession, d: str) -> DataFrame:
    """Model claims written as two sets of files, one under the older names, beside an annotation file."""
    li, at = table(spark, d, "lineitem"), scratch(spark, "claims")
    cited = F.struct(F.lit("Section").alias("provision_type"), F.col("l_suppkey").cast("string").alias("provision_number"))
    c = F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.concat(F.lit("Rule "), F.col("l_partkey").cast("string")).alias("claim_text"), F.when(F.col("l_orderkey") % 2 == 0, cited).alias("citation_extracted"), F.when(F.col("l_orderkey") % 2 == 1, cited).alias("extracted_citation"))
    docs = li.groupBy("l_orderkey").agg(F.collect_list(c).alias("claims")).withColumn("name", F.concat(F.lit("case"), F.col("l_orderkey").cast("string")))
    io.write_jsonl(docs.filter("l_orderkey % 2 = 0").select(F.col("name").alias("document_id"), "claims"), f"{at}/even")
    io.write_jsonl(docs.filter("l_orderkey % 2 = 1").select(F.lit("").alias("document_id"), F.col("name").alias("case_reference"), "claims"), f"{at}/odd")
    return io.read_model_claims(spark, f"{at}/*").select("document_id", "claim_id", "claim_text", "assertion_text", "provision_type", "provision_number")


@query("SELECT o_orderkey::VARCHAR AS document_id, 'text ' || o_custkey AS text, 0 AS source_ord FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'again ' || o_custkey, 1 FROM orders")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Generated texts of an ordered list of files, the second with its block nested."""
    o, at = table(spark, d, "orders"), scratch(spark, "texts")
    text = lambda word: F.struct(F.concat(F.lit(word), F.col("o_custkey").cast("string")).alias("text"))
    io.write_jsonl(o.select(F.col("o_orderkey").cast("string").alias("document_id"), text("text ").alias("generated_field")), f"{at}/a")
    io.write_jsonl(o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.struct(text("again ").alias("generated_field")).alias("second")), f"{at}/b")
    return io.read_texts(spark, [(f"{at}/a", None), (f"{at}/b", "second")])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    """What a stopped run has left, whose last line is broken off."""
    o, at = table(spark, d, "orders").select("o_orderkey"), scratch(spark, "done") + "/out"
    lines = o.filter("o_orderkey % 3 = 0").select(F.to_json(F.struct("o_orderkey")).alias("value")).union(spark.createDataFrame([('{"o_orderkey": 1, "x',)], "value string"))
    lines.write.text(at)
    return io.remaining(o, io.written(spark, at, "o_orderkey long"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'not rederived' ELSE 'o_custkey differs' END AS problem FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0""")
def rederived(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    again = o.filter("o_orderkey % 10 != 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")))
    return io.rederived_differences(o, again, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 <> 2) AS n_close FROM lineitem")
def tolerances(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice")
    off = F.when(F.col("l_partkey") % 3 == 0, 0.0).when(F.col("l_partkey") % 3 == 1, 0.00005).otherwise(0.01)
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(io.close_enough(x, x + off)).alias("n_close"))
