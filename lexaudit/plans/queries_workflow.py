"""Queries of extraction, verification and correction: composed claims, recorded scores and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.functions import text as T
from lexaudit.operators import bootstrap, claims, evidence, gates, reports, retrieval, verdicts, workflow
from lexaudit.plans.queries import CTE, composed_claims, query, usable
from lexaudit.session import cut, scratch, stored, table
from lexaudit.sources import io

# ---------------------------------------------------------------- golden texts of the citation grammar

IPC, CRPC = "indian penal code 1860", "code of criminal procedure 1973"
#: Text, and of each claim: type, number, subsection, act, assertion (none: the whole sentence), spans (none: the assertion).
GOLDEN = [
    ("Section 302 of the Indian Penal Code, 1860 prescribes death.", [("Section", "302", None, IPC, None, None)]),
    ("Sections 302 and 34 of the Indian Penal Code, 1860 apply.", [("Section", "302", None, IPC, None, None), ("Section", "34", None, IPC, None, None)]),
    ("Articles 1A, 31A, 31B, and 31C of the Constitution of India protect laws.", [("Article", n, None, "constitution of india", None, None) for n in ("1A", "31A", "31B", "31C")]),
    ("Art.227 of the Constitution of India guarantees it.", [("Article", "227", None, "constitution of india", None, None)]),
    ("Section 304, Part II of the Indian Penal Code, 1860 applies.", [("Section", "304", "Part II", IPC, None, None)]),
    ("Section 5(2) of the Prevention of Corruption Act, 1947 applies.", [("Section", "5", "2", "prevention of corruption act 1947", None, None)]),
    ("The Indian Penal Code, 1860 governs murder (Section 302).", [("Section", "302", None, IPC, None, None)]),
    ("Murder (Section 302) is grave.", [("Section", "302", None, "", None, None)]),
    ("Section 100 CrPC applies.", [("Section", "100", None, CRPC, None, None)]),
    ("Section 302, IPC applies.", [("Section", "302", None, IPC, None, None)]),
    ("The Regulations 2000 apply.", []),
    ("No law is named here.", []),
    ("Subsection 2 is void.", [("Section", "2", None, "", None, None)]),
    (
        "Section 302 of the Indian Penal Code prescribes death, while Section 34 of the Indian Penal Code deals with common intention.",
        [("Section", "302", None, IPC, "Section 302 of the Indian Penal Code prescribes death", None), ("Section", "34", None, IPC, "Section 34 of the Indian Penal Code deals with common intention.", None)],
    ),
    ("Sections 302 (murder), 34 (common intention) apply.", [("Section", "302", "murder", "", "Sections 302 (murder)", None), ("Section", "34", "common intention", "", "34 (common intention)", None)]),
    (
        "The case was governed by sections 302, 149, 323, and 34 of the Indian Penal Code, 1860, which respectively deal with murder, criminal conspiracy, voluntarily causing hurt, and abetting the commission of a non-cognizable offense.",
        [("Section", n, None, IPC, None, [n, x]) for n, x in (("302", "murder"), ("149", "criminal conspiracy"), ("323", "voluntarily causing hurt"), ("34", "abetting the commission of a non-cognizable offense"))],
    ),
    ("Sections 111 and 222 of the Indian Penal Code, 1860, which respectively deal with alpha-item and beta-item.", [("Section", "111", None, IPC, None, ["111", "alpha-item"]), ("Section", "222", None, IPC, None, ["222", "beta-item"])]),
    (
        "Sections 10, 20, and 30 of the Industrial Disputes Act, 1947, which respectively deal with first-topic, second-topic, and third-topic.",
        [("Section", n, None, "industrial disputes act 1947", None, [n, x]) for n, x in (("10", "first-topic"), ("20", "second-topic"), ("30", "third-topic"))],
    ),
]


def _q(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """Rows as an SQL table."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) v({names})"


_GOLDEN_ROWS = [
    (f"g{i:02d}", f"c{k + 1}", kind, number, sub, act, assertion or text, "|".join(spans or [assertion or text]))
    for i, (text, found) in enumerate(GOLDEN)
    for k, (kind, number, sub, act, assertion, spans) in enumerate(found)
]


@query(f"SELECT * FROM {values(_GOLDEN_ROWS, 'document_id, claim_id, provision_type, provision_number, subsection, act_norm, assertion_text, spans')}")
def claim_golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden texts of the grammar, read into claims."""
    texts = spark.createDataFrame([(f"g{i:02d}", t) for i, (t, _) in enumerate(GOLDEN)], "document_id string, text string")
    found = claims.extract_claims(texts)
    return found.select("document_id", "claim_id", "citation.provision_type", "citation.provision_number", "citation.subsection", "citation.act_norm", "assertion_text", F.array_join("assertion_spans", "|").alias("spans"))


# ---------------------------------------------------------------- extraction of composed texts


def order_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every order's lines as one composed text; sentences are composed when an order's lines have come together."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    ending = lambda x: F.when(x["l_linenumber"] % 3 == 0, F.lit(" deals with trade.")).otherwise(F.concat(F.lit(" of the Trade Act, "), (1950 + x["l_partkey"] % 3).cast("string"), F.lit(" prescribes a fine.")))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))  # lines that are equal in both have one sentence
    sentences = F.transform(listed, lambda x: F.concat(F.lit("Section "), (x["l_partkey"] % 60).cast("string"), ending(x)))
    return li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(sentences, " ").alias("text"))


#: Claims of ``order_texts``: a bare citation takes the one act its provision, else its document, has elsewhere.
TEXT_CLAIMS = """
x0 AS (
  SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, (l_partkey % 60)::VARCHAR AS num,
    CASE WHEN l_linenumber % 3 <> 0 THEN 'trade act ' || (1950 + l_partkey % 3) END AS act, CASE WHEN l_linenumber % 3 <> 0 THEN 'the Trade Act, ' || (1950 + l_partkey % 3) END AS raw,
    'Section ' || (l_partkey % 60) || CASE WHEN l_linenumber % 3 = 0 THEN ' deals with trade.' ELSE ' of the Trade Act, ' || (1950 + l_partkey % 3) || ' prescribes a fine.' END AS claim_text
  FROM lineitem
), x1 AS (
  SELECT *, count(DISTINCT act) OVER (PARTITION BY document_id, num) AS same_n, arg_min(raw, ord) OVER (PARTITION BY document_id, num) AS same_raw,
    count(DISTINCT act) OVER (PARTITION BY document_id) AS all_n, arg_min(raw, ord) OVER (PARTITION BY document_id) AS all_raw,
    arg_min(act, ord) OVER (PARTITION BY document_id, num) AS same_act, arg_min(act, ord) OVER (PARTITION BY document_id) AS all_act FROM x0
), tc AS (
  SELECT document_id, 'c' || ord AS claim_id, ord AS claim_ord, claim_text, num,
    coalesce(act, CASE WHEN same_n = 1 THEN same_act WHEN all_n = 1 THEN all_act END, '') AS act, coalesce(raw, CASE WHEN same_n = 1 THEN same_raw WHEN all_n = 1 THEN all_raw END) AS raw FROM x1
)"""


@query(f"""WITH {TEXT_CLAIMS} SELECT document_id, claim_id, claim_ord::INTEGER AS claim_ord, claim_text, 'Section' AS provision_type, num AS provision_number, NULL::VARCHAR AS subsection, raw AS act_raw, act AS act_norm, claim_text AS assertion_text FROM tc""")
def claim_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = claims.extract_claims(order_texts(spark, d))
    return found.select("document_id", "claim_id", F.col("claim_ord").cast("int").alias("claim_ord"), "claim_text", "citation.*", "assertion_text")


@query(f"""WITH {TEXT_CLAIMS} SELECT document_id, claim_id, num AS provision_number, row_number() OVER (PARTITION BY document_id, num, act ORDER BY claim_ord)::INTEGER AS ordinal FROM tc""")
def claim_ordinals(spark: SparkSession, d: str) -> DataFrame:
    found = claims.identity_ordinal(claims.extract_claims(order_texts(spark, d)))
    return found.select("document_id", "claim_id", F.col("identity.provision_number").alias("provision_number"), "ordinal")


def order_citations(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the orders' texts without their words, for two sides that read them: texts are parsed once, and what
    is stored is dealt out by document once a side, for acts, ordinals and the join alike."""
    found = claims.parsed_claims(order_texts(spark, d)).select("document_id", "claim_id", "claim_ord", "citation")
    return claims.inherit_acts(stored(found, "citations"))


@query(f"""WITH {TEXT_CLAIMS}, a AS (SELECT * FROM tc WHERE claim_ord <> 2), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, num, act ORDER BY claim_ord) AS k FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, num, act ORDER BY claim_ord) AS k FROM tc WHERE claim_ord <> 1)
SELECT o.document_id, o.claim_id, n.claim_id AS new_claim_id FROM o LEFT JOIN n ON o.document_id = n.document_id AND o.num = n.num AND o.act = n.act AND o.k = n.k""")
def claim_counterparts(spark: SparkSession, d: str) -> DataFrame:
    """Claims without each document's second, and their counterparts among those without its first."""
    found = order_citations(spark, d)
    return gates.counterparts(found.filter("claim_ord != 2"), found.filter("claim_ord != 1")).select("document_id", "claim_id", "new_claim_id")


@query(f"""WITH {TEXT_CLAIMS}, a AS (SELECT DISTINCT document_id, num, act FROM tc WHERE claim_ord > 1), b AS (SELECT DISTINCT document_id, num, act FROM tc)
SELECT document_id, n_new FROM (SELECT DISTINCT document_id FROM a) JOIN (SELECT b.document_id, count(*) FILTER (WHERE a.num IS NULL)::INTEGER AS n_new FROM b LEFT JOIN a ON a.document_id = b.document_id AND a.num = b.num AND a.act = b.act GROUP BY 1) USING (document_id)""")
def new_identities(spark: SparkSession, d: str) -> DataFrame:
    found = order_citations(spark, d)
    return gates.new_identities(found.filter("claim_ord > 1"), found)


@query("""WITH k AS (SELECT l_orderkey, l_partkey % 60 AS num, l_partkey % 3 AS y FROM lineitem), e AS (SELECT DISTINCT s_suppkey % 50 AS num, s_suppkey % 3 AS y FROM supplier)
SELECT l_orderkey AS document_id FROM k JOIN e USING (num, y) GROUP BY 1 HAVING count(*) >= 2""")
def overlap_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of whose raw citation keys two or more hit the evidence exactly."""
    li = table(spark, d, "lineitem")
    key = F.concat(F.lit("Section "), (F.col("l_partkey") % 60).cast("string"), F.lit(" of the Trade Act, "), (1950 + F.col("l_partkey") % 3).cast("string"))
    cases = li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_list(key).alias("raw_citation_keys"))
    act = F.concat(F.lit("The Trade Act, "), (1950 + F.col("s_suppkey") % 3).cast("string"))
    pool = table(spark, d, "supplier").select(
        F.col("s_name").alias("dataset_citation_key"), act.alias("act"), F.lit("Section").alias("provision_type"), (F.col("s_suppkey") % 50).cast("string").alias("provision_number"), F.lit(None).cast("string").alias("subsection"),
        F.col("s_name").alias("canonical_text"), F.col("s_suppkey").alias("pool_ord"), T.normal_act(act).alias("act_norm"),
    )
    return evidence.cases_with_overlap(cases, pool, 2).select("document_id")


# ---------------------------------------------------------------- verification by recorded scores

RULES = range(1, 8)


def _said(h: int) -> tuple[str, str, str]:
    """Claim, assertion and what is asked of a line's number: the narrowest certain statement."""
    whole = "Rule 7 does not apply here." if h == 7 else f"Rule {h} holds; it is broad."
    part = f"Rule {h} holds" if h % 2 == 0 else whole
    return whole, part, "the fifth rule" if h == 5 else part


def worded_claims(spark: SparkSession, d: str) -> DataFrame:
    c = composed_claims(spark, d)
    pick = lambda i: F.get(F.array(*[F.lit(_said(h)[i]) for h in RULES]), F.col("claim_id") - 1)
    spans = F.when(F.col("claim_id") == 5, F.array(F.col("citation.provision_number"), F.lit("the fifth rule"))).otherwise(F.array(pick(1)))
    return c.withColumn("claim_ord", F.col("claim_id")).withColumn("claim_text", pick(0)).withColumn("assertion_text", pick(1)).withColumn("assertion_spans", spans)


def recorded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every usable record with every rule, as if read from a file of a model's runs."""
    e = usable(spark, d)
    premise = T.premise(F.lit("labeled"), F.col("canonical_text"), F.col("provision_type"), F.col("provision_number"), F.col("act"))
    first = e.groupBy(premise.alias("premise")).agg(F.min("pool_ord").alias("k"))
    asked = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(_said(h)[2]).alias("hypothesis")) for h in RULES]))
    rows = first.select("premise", "k", asked.alias("q")).select("premise", "q.hypothesis", F.pmod(F.col("k") * 7 + F.col("q.h") * 13, F.lit(101)).alias("x"))
    scores = F.create_map(F.lit("entailment"), F.col("x") / 100.0, F.lit("neutral"), (100 - F.col("x")) / 400.0, F.lit("contradiction"), (100 - F.col("x")) * 3 / 400.0)
    return rows.select(F.sha2("premise", 256).alias("premise_hash"), F.sha2("hypothesis", 256).alias("hypothesis_hash"), scores.alias("raw_scores"), F.lit("m1").alias("verifier_model"), F.lit(100).alias("token_count"))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    matched = evidence.match_evidence(worded_claims(spark, d), usable(spark, d))
    return verdicts.verify(matched, recorded_scores(spark, d), model="m1")


VERIFIED = f"""{CTE}, fp AS (
  SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey // 10, p_name, p_type, p_partkey % 7) AS k FROM part WHERE p_partkey % 5 <> 4
), sc AS (
  SELECT matched.document_id, matched.claim_id, match_method, found, (k * 7 + matched.claim_id * 13) % 101 AS x FROM matched LEFT JOIN fp ON found = fp.p_partkey
), vd AS (
  SELECT *, greatest(x / 100.0, (100 - x) / 400.0, (100 - x) * 3 / 400.0)::DOUBLE AS c, CASE WHEN x / 100.0 >= (100 - x) * 3 / 400.0 THEN 'ENTAILED' ELSE 'CONTRADICTED' END AS l FROM sc
), vf AS (
  SELECT document_id, claim_id, match_method, CASE WHEN found IS NULL THEN 'NO_EVIDENCE' WHEN c < 0.7 THEN 'NOT_ENOUGH_INFORMATION' ELSE l END AS verdict, CASE WHEN found IS NOT NULL THEN c END AS confidence,
    CASE WHEN found IS NOT NULL AND c < 0.7 THEN 'low_confidence' END AS sub_reason, CASE WHEN found IS NULL THEN NULL WHEN c < 0.7 THEN 'low_confidence_nei' WHEN l = 'CONTRADICTED' THEN 'contradicted' END AS trigger_reason,
    found IS NOT NULL AND c >= 0.7 AND l = 'CONTRADICTED' AND claim_id = 7 AS negation_caveat FROM vd
)"""


@query(f"WITH {VERIFIED} SELECT document_id, claim_id, verdict, round(confidence, 6) AS confidence, sub_reason, trigger_reason, negation_caveat FROM vf")
def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    """Linked claims scored by record under the labeled framing, each by its narrowest statement."""
    v = _verified(spark, d)
    return v.select("document_id", "claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "sub_reason", "trigger_reason", "negation_caveat")


@query(f"""WITH {VERIFIED} SELECT match_method, count(*) FILTER (WHERE verdict = 'ENTAILED') AS "ENTAILED", count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS "CONTRADICTED",
count(*) FILTER (WHERE verdict = 'NOT_ENOUGH_INFORMATION') AS "NOT_ENOUGH_INFORMATION", count(*) FILTER (WHERE verdict = 'NO_EVIDENCE') AS "NO_EVIDENCE" FROM vf GROUP BY 1""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.verdict_counts(_verified(spark, d), "match_method")


@query(f"""WITH {VERIFIED} SELECT document_id, min(claim_id) AS claim_id FROM vf WHERE trigger_reason IS NOT NULL AND NOT negation_caveat GROUP BY 1""")
def flagged_claims(spark: SparkSession, d: str) -> DataFrame:
    return gates.flagged_claim(_verified(spark, d)).select("document_id", "claim_id")


@query(f"""WITH {VERIFIED} SELECT match_method, sub_reason, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max FROM vf WHERE verdict = 'NOT_ENOUGH_INFORMATION' GROUP BY ALL""")
def nei_breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = reports.nei_breakdown(_verified(spark, d))
    return b.select("match_method", "sub_reason", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query(f"""WITH {CTE} SELECT count(*) AS n_claims, count(*) FILTER (WHERE match_method <> 'no_evidence') AS n_with_evidence, count(*) FILTER (WHERE match_method = 'no_evidence') AS n_without_evidence FROM matched""")
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(evidence.match_evidence(composed_claims(spark, d), usable(spark, d))).drop("coverage_pct")


_HALF = CTE.replace("p_partkey % 5 <> 4", "p_partkey % 5 <> 4 AND p_partkey % 2 = 0")


@query(f"""WITH a AS (WITH {_HALF} SELECT document_id, claim_id, match_method <> 'no_evidence' AS had FROM matched), b AS (WITH {CTE} SELECT document_id, claim_id, match_method <> 'no_evidence' AS has FROM matched)
SELECT CASE WHEN had AND has THEN 'both' WHEN has THEN 'gained' WHEN had THEN 'lost' ELSE 'neither' END AS change, count(*) AS n FROM a JOIN b USING (document_id, claim_id) GROUP BY 1""")
def coverage_change(spark: SparkSession, d: str) -> DataFrame:
    """Claims by what the records of even parts, and all records, make of them."""
    e, c = usable(spark, d), composed_claims(spark, d)
    return evidence.coverage_change(evidence.match_evidence(c, e.filter("pool_ord % 2 = 0")), evidence.match_evidence(c, e))


_WORDS = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z'']+')), lambda x: length(x) > 2 AND NOT list_contains(['the','of','and','in','for','to','a','an','this','that','act','constitution','india'], x))"


@query(f"""WITH {CTE}, dt AS (SELECT DISTINCT act AS doc, ws AS ts FROM w), n AS (SELECT count(*) AS n, avg(len(ts)) AS ml FROM dt), t AS (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM dt), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df CROSS JOIN n), i1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
wt AS (SELECT doc, t.term, idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / ml)) AS weight FROM t JOIN i1 ON t.term = i1.term CROSS JOIN n), self AS (SELECT doc, sum(weight) AS self FROM wt GROUP BY 1),
q AS (SELECT DISTINCT act AS query, num FROM m0 WHERE e1 IS NULL AND e2 IS NULL), pr AS (SELECT DISTINCT q.query, q.num, w.act AS doc FROM q JOIN w ON q.num = w.num),
qt AS (SELECT query, unnest({_WORDS.format('query')}) AS term FROM (SELECT DISTINCT query FROM q)), s AS (SELECT pr.query, pr.num, pr.doc, sum(weight) AS score FROM pr JOIN qt ON pr.query = qt.query JOIN wt ON wt.doc = pr.doc AND wt.term = qt.term GROUP BY ALL),
sim AS (SELECT query, num, s.doc, CASE WHEN self > 0 THEN least(1.0, score / self) ELSE 0 END AS sim FROM s JOIN self ON s.doc = self.doc),
b2 AS (SELECT v.row, max(coalesce(sim, 0)) FILTER (WHERE NOT veto) AS top FROM v JOIN fz ON v.row = fz.row JOIN w ON w.num = v.num AND w.ord = fz.ord LEFT JOIN sim ON sim.query = v.act AND sim.num = v.num AND sim.doc = w.act GROUP BY 1)
SELECT CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL THEN 'exact_normalized' WHEN round(top, 6) >= 0.8 THEN 'fuzzy' ELSE 'no_evidence' END AS match_method, count(*) AS n FROM m0 LEFT JOIN b2 USING (row) GROUP BY 1""")
def evidence_by_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Linkage with BM25's self-score ratio in place of the word overlap."""
    c, e = composed_claims(spark, d), usable(spark, d)
    index = retrieval.bm25_index(e.select("act_norm"))
    cited = c.select(F.col("citation.act_norm").alias("query"), F.col("citation.provision_number").alias("number")).distinct()
    similar = retrieval.bm25_among(cited, e.select(F.col("provision_number").alias("number"), F.col("act_norm").alias("doc")), index, "number")
    matched = evidence.match_evidence(c, e, scores=similar.withColumn("similarity", F.round("similarity", 6)))
    return matched.groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


#: A name's vector: that of the embedding whose number is the hash of its first word, so that forms of an act may share one.
@query(f"""WITH {CTE}, e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS x, count(*) OVER () AS n FROM embeddings),
q AS (SELECT DISTINCT act AS query, num FROM m0 WHERE e1 IS NULL AND e2 IS NULL), pr AS (SELECT DISTINCT q.query, q.num, w.act AS doc FROM q JOIN w ON q.num = w.num),
nm AS (SELECT DISTINCT name FROM (SELECT query AS name FROM q UNION ALL SELECT act FROM w)),
vec AS (SELECT name, x FROM (SELECT name, ('0x' || substr(md5(split_part(name, ' ', 1)), 1, 8))::BIGINT % (SELECT any_value(n) FROM e) AS i FROM nm) JOIN e USING (i)),
sim AS (SELECT pr.query, pr.num, pr.doc, round(list_cosine_similarity(a.x, b.x), 6) AS sim FROM pr JOIN vec a ON a.name = pr.query JOIN vec b ON b.name = pr.doc),
b2 AS (SELECT v.row, max(coalesce(sim, 0)) FILTER (WHERE NOT veto) AS top FROM v JOIN fz ON v.row = fz.row JOIN w ON w.num = v.num AND w.ord = fz.ord LEFT JOIN sim ON sim.query = v.act AND sim.num = v.num AND sim.doc = w.act GROUP BY 1)
SELECT CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL THEN 'exact_normalized' WHEN round(top, 6) >= 0.8 THEN 'fuzzy' ELSE 'no_evidence' END AS match_method, count(*) AS n FROM m0 LEFT JOIN b2 USING (row) GROUP BY 1""")
def evidence_by_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Linkage with the cosine of the names' vectors in place of the word overlap."""
    c, e = composed_claims(spark, d), usable(spark, d)
    table_ = bootstrap.numbered(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id"))
    n = table_.count()
    names = c.select(F.col("citation.act_norm").alias("name")).union(e.select("act_norm")).distinct()
    at = F.conv(F.substring(F.md5(F.split("name", " ")[0]), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    embedded = names.withColumn("u", at).join(table_, "u").select("name", F.col("embedding").alias("vector"))
    cited = c.select(F.col("citation.act_norm").alias("query"), F.col("citation.provision_number").alias("number")).distinct()
    similar = retrieval.cosine_among(cited, e.select(F.col("provision_number").alias("number"), F.col("act_norm").alias("doc")), embedded, "number")
    matched = evidence.match_evidence(c, e, scores=similar.withColumn("similarity", F.round("similarity", 6)))
    return matched.groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- corrections

_S1, _S2 = "Section 1 of the Trade Act, 1950 prescribes a fine of ten.", "Section 2 of the Trade Act, 1950 prescribes a term of two years."
_S1B, _FIVE, _SIX = "Section 1 of the Trade Act, 1950 governs trade.", "Section 1 of the Trade Act, 1950 prescribes a fine of five.", "Section 1 of the Trade Act, 1950 prescribes a fine of six."
_PAIR = "Section 1 of the Trade Act, 1950 prescribes a fine of ten; Section 3 of the Trade Act, 1950 governs ports."
_JOINED = "Section 1 of the Trade Act, 1950 prescribes a levy and Section 3 of the Trade Act, 1950 governs ports."
_ADDED = "Section 1 of the Trade Act, 1950 and Section 9 of the Trade Act, 1950 prescribe a fine."
_LISTED = "Sections 1 and 3 of the Trade Act, 1950, which respectively deal with large fines and small ports."
#: Text, proposal for its flagged claim, status, reverified verdict; by sentence.
BY_SENTENCE = [
    (_S2, None, "not_triggered", None),
    (f"{_S1} {_S2}", _FIVE, "corrected", "ENTAILED"),
    (f"{_S1} {_S2}", f"{_FIVE} And more.", "correction_scope_violation", None),
    (f"{_S1} {_S2}", " ", "correction_scope_violation", None),
    (f"{_S1} {_S1} {_S2}", _FIVE, "correction_sentence_splice_unavailable", None),
    (_PAIR, _FIVE, "correction_scope_violation", None),
    (f"{_S1} {_S2}", _ADDED, "correction_unauthorized_addition", None),
    (f"{_S1} {_S1B}", _S1B, "correction_ordinal_ambiguous", None),
    (f"{_S1} {_S2}", _SIX, "correction_failed", "NOT_ENOUGH_INFORMATION"),
    (f"{_S1} {_S2}", "The rule prescribes a fine of five.", "correction_failed", None),
]
#: The same with the other claims' spans to survive, and their counterparts verified again.
BY_SPANS_KEPT = [(_PAIR, _JOINED, "correction_sibling_regression", "ENTAILED"), (_PAIR, _PAIR.replace("ten;", "five;"), "corrected", "ENTAILED"), (f"{_S1} {_S2}", _FIVE, "corrected", "ENTAILED")]
#: By span: the flagged claim's last span is replaced.
BY_SPAN = [
    (_S2, None, "not_triggered", None),
    (_PAIR, "Section 1 of the Trade Act, 1950 prescribes a fine of five", "corrected", "ENTAILED"),
    (_PAIR, "", "correction_splice_unavailable", None),
    (_LISTED, "fines up to five", "corrected", "ENTAILED"),
    (f"{_S1} {_S1}", _FIVE, "correction_splice_unavailable", None),
    (f"{_S1} {_S2}", _ADDED, "correction_unauthorized_addition", None),
    (f"{_S1} {_S1B}", _S1B, "correction_ordinal_ambiguous", None),
    (f"{_S1} {_S2}", _SIX, "correction_failed", "NOT_ENOUGH_INFORMATION"),
    (f"{_S1} {_S2}", "The rule prescribes a fine of five.", "correction_failed", None),
]


def _trade_act(spark: SparkSession) -> DataFrame:
    rows = [(f"Section {k} in The Trade Act, 1950", "The Trade Act, 1950", "Section", str(k), None, f"Text {k}.", "trade act 1950", k) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "dataset_citation_key string, act string, provision_type string, provision_number string, subsection string, canonical_text string, act_norm string, pool_ord long")


def _trade_scores(spark: SparkSession) -> DataFrame:
    """Recorded scores of what the workflow asks about the Trade Act."""
    yes, no, low = (0.9, 0.05, 0.05), (0.05, 0.05, 0.9), (0.5, 0.3, 0.2)
    said = [
        (1, _S1, no), (2, _S2, yes), (1, _FIVE, yes), (1, _SIX, low), (1, _S1B, yes), (1, "Section 1 of the Trade Act, 1950 prescribes a fine of ten", no), (3, "Section 3 of the Trade Act, 1950 governs ports.", yes),
        (1, _JOINED, yes), (3, _JOINED, no), (1, "Section 1 of the Trade Act, 1950 prescribes a fine of five", yes), (1, _PAIR.replace("ten;", "five;"), yes), (1, "large fines", no), (3, "small ports", yes),
        (1, _LISTED.replace("large fines", "fines up to five"), yes), (3, _LISTED.replace("large fines", "fines up to five"), yes),
    ]
    rows = [(f"Section {k} of The Trade Act, 1950: Text {k}.", h, dict(zip(("entailment", "neutral", "contradiction"), s, strict=True))) for k, h, s in said]
    df = spark.createDataFrame(rows, "premise string, hypothesis string, raw_scores map<string,double>")
    return df.select(F.sha2("premise", 256).alias("premise_hash"), F.sha2("hypothesis", 256).alias("hypothesis_hash"), "raw_scores", F.lit(50).alias("token_count"))


def corrected_orders(spark: SparkSession, d: str, kinds: list[tuple], by_span: bool = False, strictness: str = "claim_text") -> tuple[DataFrame, DataFrame]:
    """Every order with one of the texts: its verified claims, and what became of it. Orders of one text and proposal are one case."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.pmod("o_orderkey", F.lit(len(kinds))).cast("int").alias("kind"))
    cases = F.broadcast(spark.createDataFrame([(i, k[0], k[1]) for i, k in enumerate(kinds)], "k int, text string, proposal string"))
    docs, members = workflow.distinct_cases(keys.join(cases, F.col("kind") == F.col("k")).select("document_id", "text", "proposal"))
    pool, scores = _trade_act(spark), _trade_scores(spark)
    found = claims.extract_claims(docs, distinct_texts=True)
    judged = cut(verdicts.verify(evidence.match_evidence(cut(found), pool), scores))
    said = workflow.targets(judged, by_span).select("document_id", "target_claim_id").join(docs.select("document_id", "proposal"), "document_id")
    fixed = workflow.correct(docs, judged, said, pool, scores, by_span, strictness)
    return workflow.of_all(judged, members), workflow.of_all(fixed, members)


def _expected(kinds: list[tuple], by_span: bool = False) -> str:
    rows = []
    for i, (text, proposal, status, reverified) in enumerate(kinds):
        final = text
        if status == "corrected" and by_span:
            final = text.replace("large fines" if text == _LISTED else _S1[:-1], proposal)
        elif status == "corrected":
            final = text.replace(text if text == _PAIR else _S1, proposal)
        source = "original" if status in ("not_triggered", "correction_sentence_splice_unavailable") else status
        rows.append((i, status, reverified, 0 if status == "not_triggered" else 1, 1 if status == "correction_sibling_regression" else 0, final, source))
    return f"SELECT o_orderkey AS document_id, status, reverified, attempts, n_regressions::BIGINT AS n_regressions, final_text, source FROM orders JOIN {values(rows, 'kind, status, reverified, attempts, n_regressions, final_text, source')} ON o_orderkey % {len(kinds)} = kind"


def _shown(corrected: DataFrame) -> DataFrame:
    return corrected.select("document_id", "status", "reverified", "attempts", "n_regressions", F.col("final_field.text").alias("final_text"), F.col("final_field.source").alias("source"))


@query(_expected(BY_SENTENCE))
def corrections_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _shown(corrected_orders(spark, d, BY_SENTENCE)[1])


@query(_expected(BY_SPANS_KEPT))
def corrections_with_recheck(spark: SparkSession, d: str) -> DataFrame:
    return _shown(corrected_orders(spark, d, BY_SPANS_KEPT, strictness="assertion_spans")[1])


@query(_expected(BY_SPAN, True))
def corrections_by_span(spark: SparkSession, d: str) -> DataFrame:
    return _shown(corrected_orders(spark, d, BY_SPAN, True, "assertion_spans")[1])


_STATUSES = values([(i, k[2], k[3]) for i, k in enumerate(BY_SENTENCE)], "kind, status, reverified")


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE status <> 'not_triggered') AS n_triggered, count(*) FILTER (WHERE status = 'corrected') AS n_corrected, count(*) FILTER (WHERE status LIKE 'correction%') AS n_blocked,
count(*) FILTER (WHERE status = 'correction_failed') AS n_failed FROM orders JOIN {_STATUSES} ON o_orderkey % {len(BY_SENTENCE)} = kind""")
def correction_funnel(spark: SparkSession, d: str) -> DataFrame:
    return gates.funnel(corrected_orders(spark, d, BY_SENTENCE)[1])


@query(f"""SELECT cause, count(*) AS n FROM (SELECT CASE WHEN status = 'correction_failed' THEN CASE WHEN reverified IS NULL THEN 'citation_identity_lost' WHEN reverified = 'NO_EVIDENCE' THEN 'evidence_lost_after_edit' ELSE 'reverification_not_entailed' END
WHEN status IN ('correction_scope_violation', 'correction_sibling_regression', 'correction_ordinal_ambiguous', 'correction_unauthorized_addition', 'not_triggered') THEN status END AS cause FROM orders JOIN {_STATUSES} ON o_orderkey % {len(BY_SENTENCE)} = kind) GROUP BY 1""")
def correction_causes(spark: SparkSession, d: str) -> DataFrame:
    c = corrected_orders(spark, d, BY_SENTENCE)[1]
    return c.groupBy(gates.failure_cause(F.col("status"), F.col("reverified")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT o_orderkey, status FROM orders JOIN {_STATUSES} ON o_orderkey % {len(BY_SENTENCE)} = kind), b AS (SELECT o_orderkey, status FROM orders JOIN {values([(i, k[2]) for i, k in enumerate(BY_SPAN)], 'kind, status')} ON o_orderkey % {len(BY_SPAN)} = kind)
SELECT a.status AS first_status, b.status AS second_status, (a.status = 'not_triggered') = (b.status = 'not_triggered') AS same_claim, count(*) AS n FROM a JOIN b USING (o_orderkey) GROUP BY ALL""")
def correction_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Both conditions' statuses side by side, and whether they flagged the same claim."""
    name = lambda c: c.withColumnRenamed("target_claim_id", "triggered_for_claim_id")
    both = reports.correction_pairs(name(corrected_orders(spark, d, BY_SENTENCE)[1]), name(corrected_orders(spark, d, BY_SPAN, True, "assertion_spans")[1]))
    return both.groupBy("first_status", "second_status", "same_claim").agg(F.count(F.lit(1)).alias("n"))


_RECORDS = [(i, k[2], {_S2: 1, f"{_S1} {_S1} {_S2}": 3, f"{_S1} {_S1B}": 2}.get(k[0], 2), "original" if k[2] in ("not_triggered", "correction_sentence_splice_unavailable") else k[2]) for i, k in enumerate(BY_SENTENCE)]


@query(f"""SELECT o_orderkey AS document_id, n AS n_claims, n::BIGINT AS n_with_evidence, (n - {{0}})::BIGINT AS n_entailed, {{0}}::BIGINT AS n_contradicted, status, source FROM orders
JOIN (SELECT *, {{1}} FROM {values(_RECORDS, 'kind, status, n, source')}) ON o_orderkey % {len(BY_SENTENCE)} = kind""".replace("{0}", "flagged").replace("{1}", f"CASE kind {' '.join(f'WHEN {i} THEN {k[0].count(_S1) if k[0] != _PAIR else 1}' for i, k in enumerate(BY_SENTENCE))} END AS flagged"))
def case_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Texts to nested records: extraction, linkage, recorded scores, verdicts, corrections, final field."""
    judged, fixed = corrected_orders(spark, d, BY_SENTENCE)
    records = reports.case_records(judged.select("document_id").distinct(), judged, fixed)
    return records.select(
        "document_id", F.size("claims").alias("n_claims"), F.col("evidence.with_evidence").alias("n_with_evidence"), F.col(f"verification.{S.ENTAILED}").alias("n_entailed"),
        F.col(f"verification.{S.CONTRADICTED}").alias("n_contradicted"), "correction.status", F.col("final_field.source").alias("source"),
    )


# ---------------------------------------------------------------- verification helpers


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 100) / 100.0::DOUBLE AS a1, (l_suppkey % 100) / 100.0::DOUBLE AS a2 FROM lineitem),
m AS (SELECT *, (a1 + a2) / 2 AS e, ((1 - a1) * 0.25 + (1 - a2) * 0.25) / 2 AS n, ((1 - a1) * 0.75 + (1 - a2) * 0.75) / 2 AS k FROM c),
v AS (SELECT *, CASE WHEN round(greatest(e, n, k), 9) < 0.7 THEN 'NOT_ENOUGH_INFORMATION' WHEN e >= n AND e >= k THEN 'ENTAILED' WHEN n >= k THEN 'NOT_ENOUGH_INFORMATION' ELSE 'CONTRADICTED' END AS label,
  CASE WHEN round(greatest(a1, (1 - a1) * 0.75), 9) < 0.7 THEN 'NOT_ENOUGH_INFORMATION' WHEN a1 >= (1 - a1) * 0.75 THEN 'ENTAILED' ELSE 'CONTRADICTED' END AS prefix FROM m)
SELECT label, prefix AS prefix_label, label <> prefix AS changes, count(*) AS n FROM v GROUP BY ALL""")
def chunked_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of premises in two chunks: mean of the chunks, and what the first alone would say."""
    li = table(spark, d, "lineitem")
    one, two = (F.pmod(c, F.lit(100)) / 100.0 for c in ("l_partkey", "l_suppkey"))
    chunk = lambda a: F.array(a, (1 - a) * 0.25, (1 - a) * 0.75)
    v = li.select(verdicts.chunk_verdict(F.array(chunk(one), chunk(two))).alias("v"))
    return v.groupBy(F.col("v.label").alias("label"), F.col("v.prefix_label").alias("prefix_label"), F.col("v.changes").alias("changes")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, len(w) AS n_tokens, greatest(1, ceil(len(w) / 47.0))::INTEGER AS n_chunks, len(w) - 47 * (greatest(1, ceil(len(w) / 47.0))::INTEGER - 1) AS last_chunk FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations)""")
def premise_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    chunks = stats.premise_chunks(F.col("w"), F.lit(14), 64)
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), F.size(chunks).alias("n_chunks"), F.size(F.element_at(chunks, -1)).cast("long").alias("last_chunk"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ENTAILED' WHEN 1 THEN 'ENTAILED' WHEN 2 THEN 'CONTRADICTED' ELSE 'NOT_ENOUGH_INFORMATION' END AS label FROM documents""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Labels read from free answers; a denied label reads as that label."""
    answers = F.array(F.lit("It is entailed."), F.lit("NOT ENTAILED"), F.lit("clearly Contradicted"), F.lit("cannot tell"))
    return table(spark, d, "documents").select("doc_id", verdicts.llm_label(F.get(answers, (F.col("doc_id") % 4).cast("int"))).alias("label"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_name, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'bare' ELSE 'labeled' END AS framing, CASE WHEN p_partkey % 4 = 1 THEN '' ELSE p_brand END AS act FROM part)
SELECT p_partkey, CASE WHEN framing = 'labeled' AND act <> '' THEN 'Section ' || p_size || ' of ' || act || ': ' || p_name ELSE p_name END AS premise FROM p""")
def premise_framing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    framing, act = F.when(F.col("p_partkey") % 4 == 0, "bare").otherwise("labeled"), F.when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_brand"))
    return p.select("p_partkey", T.premise(framing, F.col("p_name"), F.lit("Section"), F.col("p_size").cast("string"), act).alias("premise"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a b a c' WHEN 1 THEN NULL WHEN 2 THEN 'x z y' ELSE NULL END AS spliced FROM orders""")
def splices(spark: SparkSession, d: str) -> DataFrame:
    """A fragment is replaced where it stands exactly once: once, twice, once inside, never."""
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.splice_once(pick("a b Q c", "Q Q", "x Q y", "x"), F.lit("Q"), pick("a", "z", "z", "z")).alias("spliced"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true ELSE false END AS valid FROM orders""")
def span_checks(spark: SparkSession, d: str) -> DataFrame:
    spans = F.get(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in (["34", "ports"], ["34", ""], ["docks"], [])]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", gates.spans_valid(spans, F.lit("34 deals with ports")).alias("valid"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey % 3 <> 0) AS n_by_sentence, count(*) FILTER (WHERE o_custkey % 3 = 2) AS n_by_assertion, count(*) FILTER (WHERE o_custkey % 6 = 5) AS n_by_spans, count(*) FILTER (WHERE o_custkey % 3 <> 0 AND o_custkey % 6 <> 5) AS n_unblocked FROM orders""")
def scope_replay(spark: SparkSession, d: str) -> DataFrame:
    """Violations replayed at three strictnesses: the sentence, the assertion or the spans are gone."""
    k = F.col("o_custkey")
    text = F.when(k % 3 == 0, "Rule 1 holds; rule 2 too.").when(k % 3 == 1, "Rule 1 holds; rule 2 is void.").when(k % 6 == 5, "All is void.").otherwise("Rule one holds, 1 stays.")
    rows = table(spark, d, "orders").select(F.lit("Rule 1 holds; rule 2 too.").alias("claim_text"), F.lit("Rule 1 holds").alias("assertion_text"), F.array(F.lit("1")).alias("assertion_spans"), text.alias("corrected_text"))
    return reports.scope_replay(rows)


@query("""SELECT o_orderkey, 'You label text.' || chr(10) || chr(10) || o_orderstatus AS prompt FROM orders""")
def role_prompts(spark: SparkSession, d: str) -> DataFrame:
    return reports.role_prompts(table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("one two "), "o_orderstatus").alias("Text")), "You label text.", 1).select("o_orderkey", "prompt")


def hook_rows(spark: SparkSession, d: str) -> DataFrame:
    return worded_claims(spark, d).select("document_id", "claim_id", F.col("claim_text").alias("hypothesis"), F.col("citation.act_norm").alias("premise"))


@query("""SELECT l_orderkey AS document_id, l_linenumber AS claim_id, round((length(CASE l_linenumber WHEN 7 THEN 'Rule 7 does not apply here.' ELSE 'Rule 1 holds; it is broad.' END) % 10) / 10.0::DOUBLE, 6) AS entailment FROM lineitem""")
def scorer_hook(spark: SparkSession, d: str) -> DataFrame:
    """A scorer as a plug-in: made once a task, fed Arrow batches."""

    def scorer():
        return lambda b: b["hypothesis"].map(lambda h: {"entailment": (len(h) % 10) / 10.0, "neutral": 0.0, "contradiction": 0.0})

    s = verdicts.score_with(hook_rows(spark, d), scorer)
    return s.select("document_id", "claim_id", F.round(F.col("raw_scores")["entailment"], 6).alias("entailment"))


@query("""SELECT l_orderkey AS document_id, l_linenumber AS claim_id, CASE WHEN l_linenumber = 7 THEN 'CONTRADICTED' WHEN l_linenumber % 2 = 0 THEN 'NOT_ENOUGH_INFORMATION' ELSE 'ENTAILED' END AS label, true AS small FROM lineitem""")
def batched_verifier(spark: SparkSession, d: str) -> DataFrame:
    """A verifier that answers in words, sixteen pairs at a time, read into labels."""
    answers = {"7": "It is CONTRADICTED.", "0": "Not enough information", "1": "Clearly ENTAILED, not contradicted"}

    def scorer():
        def answer(b):
            return [{answers["7" if n == 7 else str(n % 2)]: float(len(b))} for n in b["claim_id"].tolist()]

        return answer

    s = verdicts.score_with(hook_rows(spark, d).select("document_id", "claim_id", "premise", "hypothesis"), scorer, 16)
    answer = F.map_keys("raw_scores")[0]
    return s.select("document_id", "claim_id", verdicts.llm_label(answer).alias("label"), (F.map_values("raw_scores")[0] <= 16).alias("small"))


@query(f"""SELECT o_orderkey AS document_id, CASE WHEN kind = 7 THEN 'c1' WHEN kind = 0 THEN NULL ELSE 'c1' END AS target_claim_id, 'FIX ' || sentence AS proposal
FROM orders JOIN {values([(i, _PAIR if k[0] == _PAIR else _S1) for i, k in enumerate(BY_SENTENCE) if i], 'kind, sentence')} ON o_orderkey % {len(BY_SENTENCE)} = kind""")
def corrector_hook(spark: SparkSession, d: str) -> DataFrame:
    """A corrector as a plug-in, asked for the flagged claims."""

    def corrector():
        return lambda b: "FIX " + b["original"]

    judged, _ = corrected_orders(spark, d, BY_SENTENCE)
    return workflow.propose_with(workflow.targets(judged), corrector)


# ---------------------------------------------------------------- every form of citation, composed from columns

#: Text and claims (type, number, subsection, act, assertion, spans) of each form; {a} to {d} are numbers of the row, {y} is a year.
FORMS = [
    ("Sections {a} and {b} of the Indian Penal Code, 1860 apply.", [("Section", "{a}", None, IPC, None, None), ("Section", "{b}", None, IPC, None, None)]),
    ("Articles {a}A, {b}A, {c}B, and {d}C of the Constitution of India protect laws.", [("Article", n, None, "constitution of india", None, None) for n in ("{a}A", "{b}A", "{c}B", "{d}C")]),
    ("Section {a}, Part II of the Indian Penal Code, 1860 applies.", [("Section", "{a}", "Part II", IPC, None, None)]),
    ("The Indian Penal Code, 1860 governs murder (Section {a}).", [("Section", "{a}", None, IPC, None, None)]),
    ("Section {a} CrPC applies.", [("Section", "{a}", None, CRPC, None, None)]),
    ("Section {a}, IPC applies.", [("Section", "{a}", None, IPC, None, None)]),
    (
        "Section {a} of the Indian Penal Code prescribes death, while Section {b} of the Indian Penal Code deals with common intention.",
        [("Section", "{a}", None, IPC, "Section {a} of the Indian Penal Code prescribes death", None), ("Section", "{b}", None, IPC, "Section {b} of the Indian Penal Code deals with common intention.", None)],
    ),
    ("Sections {a} and {b} of the Indian Penal Code, 1860, which respectively deal with alpha-item and beta-item.", [("Section", "{a}", None, IPC, None, ["{a}", "alpha-item"]), ("Section", "{b}", None, IPC, None, ["{b}", "beta-item"])]),
    (
        "Sections {a}, {b}, and {c} of the Industrial Disputes Act, 1947, which respectively deal with first-topic, second-topic, and third-topic.",
        [("Section", n, None, "industrial disputes act 1947", None, [n, x]) for n, x in (("{a}", "first-topic"), ("{b}", "second-topic"), ("{c}", "third-topic"))],
    ),
    ("Sections {a} (murder), {b} (common intention) apply.", [("Section", "{a}", "murder", "", "Sections {a} (murder)", None), ("Section", "{b}", "common intention", "", "{b} (common intention)", None)]),
    ("Section {a}(2) of the Prevention of Corruption Act, 1947 applies.", [("Section", "{a}", "2", "prevention of corruption act 1947", None, None)]),
    ("Murder (Section {a}) is grave.", [("Section", "{a}", None, "", None, None)]),
    ("The Regulations {y} apply.", []),
    ("Art.{a} of the Constitution of India guarantees it.", [("Article", "{a}", None, "constitution of india", None, None)]),
]
_FORM_ROWS = [(i, f"c{k + 1}", *c[:4], c[4] or text, "|".join(c[5] or [c[4] or text])) for i, (text, found) in enumerate(FORMS) for k, c in enumerate(found)]
_FILL = "replace(replace(replace(replace({0}, '{{a}}', a), '{{b}}', b), '{{c}}', c), '{{d}}', d)"


@query(f"""WITH p AS (SELECT p_partkey AS document_id, p_partkey % {len(FORMS)} AS form, (100 + p_partkey % 300)::VARCHAR AS a, (401 + p_partkey % 90)::VARCHAR AS b, (501 + p_size)::VARCHAR AS c, (601 + p_partkey % 7)::VARCHAR AS d FROM part)
SELECT document_id, claim_id, provision_type, {_FILL.format('provision_number')} AS provision_number, subsection, act_norm, {_FILL.format('assertion_text')} AS assertion_text, {_FILL.format('spans')} AS spans
FROM p JOIN {values(_FORM_ROWS, 'form, claim_id, provision_type, provision_number, subsection, act_norm, assertion_text, spans')} USING (form)""")
def citation_forms(spark: SparkSession, d: str) -> DataFrame:
    """A text for every part, in one of the forms that the grammar knows, read into claims."""
    p = table(spark, d, "part")
    text = F.get(F.array(*[F.lit(t) for t, _ in FORMS]), (F.col("p_partkey") % len(FORMS)).cast("int"))
    numbers = {"a": 100 + F.col("p_partkey") % 300, "b": 401 + F.col("p_partkey") % 90, "c": 501 + F.col("p_size"), "d": 601 + F.col("p_partkey") % 7, "y": 1950 + F.col("p_partkey") % 60}
    for name, n in numbers.items():
        text = F.replace(text, F.lit("{" + name + "}"), n.cast("string"))
    found = claims.extract_claims(p.select(F.col("p_partkey").alias("document_id"), text.alias("text")))
    return found.select("document_id", "claim_id", "citation.provision_type", "citation.provision_number", "citation.subsection", "citation.act_norm", "assertion_text", F.array_join("assertion_spans", "|").alias("spans"))


# ---------------------------------------------------------------- sources that the tables are written to and read from


@query("""SELECT c_custkey::VARCHAR AS document_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS case_text,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Section ' || c_nationkey || ' in ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',Section 1 in Act' ELSE '' END END AS keys FROM customer""")
def case_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files of JSON arrays, one a nation, read as cases; some without a text or sections."""
    path = scratch(spark, "cases")
    section = F.concat(F.lit("Section "), F.col("c_nationkey").cast("string"), F.lit(" in "), F.col("c_mktsegment"))
    sections = F.when(F.col("c_custkey") % 5 != 0, F.when(F.col("c_custkey") % 2 == 0, F.create_map(section, F.lit("x"), F.lit("Section 1 in Act"), F.lit("y"))).otherwise(F.create_map(section, F.lit("x"))))
    one = F.struct(F.col("c_custkey").cast("string").alias("document_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("summarized_text"), sections.alias("sections"))
    table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("c_nationkey").text(path)
    return io.read_cases(spark, [path]).select("document_id", "case_text", F.array_join("raw_citation_keys", ",").alias("keys"))


@query("""SELECT o_orderpriority AS priority, true AS present, (sum(length(o_orderkey::VARCHAR) + 1))::BIGINT AS size, sha256(string_agg(o_orderkey::VARCHAR || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM orders GROUP BY 1
UNION ALL SELECT 'none', false, NULL, NULL""")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Orders' keys as a file for each priority, and their manifest; one file that is expected is missing."""
    path = scratch(spark, "manifest")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey")
    o.repartition("priority").sortWithinPartitions("priority", "o_orderkey").select("priority", F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("priority").text(path)
    names = [r["f"] for r in spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "(priority=[^/]+/[^/]+)$", 1).alias("f")).collect()]
    found = io.manifest(spark, path, [*names, "priority=none/part.txt"])
    return found.select(F.url_decode(F.regexp_extract("path", "priority=([^/]+)/", 1)).alias("priority"), "present", "size", "sha256")


@query("SELECT conv_id, turn, left(coalesce(text, ''), 20) || ' (' || length(coalesce(text, '')) || ')' AS text FROM conversations")
def generated_fields(spark: SparkSession, d: str) -> DataFrame:
    """A generator that is given every turn's text."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("case_text"))
    made = workflow.generate_with(c, lambda: lambda texts: texts.str.slice(0, 20) + " (" + texts.str.len().astype(str) + ")")
    return made.select("conv_id", "turn", "text")
