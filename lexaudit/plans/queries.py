"""Queries over the standard tables. Citation texts are composed from columns, as no table holds any.

Evidence is made of ``part``, claims of ``lineitem``, predictions of ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.functions import text as T
from lexaudit.operators import benchmarks, claims, evidence, gates, metrics, reports, retrieval, review, selection, verdicts
from lexaudit.session import grown, table
from lexaudit.sources import io
from lexaudit.streaming import stages

LONG = "long"


# ---------------------------------------------------------------- composed inputs


def dealt_parts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``part`` dealt out by key: its file is so small that one or two tasks read it, which would do all composing and
    hold all that is composed. A given number of partitions is one that the planner doesn't bring down again."""
    return table(spark, d, "part").select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def composed_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = dealt_parts(spark, d, "p_partkey", "p_name", "p_type")
    number = F.floor(F.col("p_partkey") / 10).cast("string")
    act = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" "), F.initcap(F.lower("p_type")), F.lit(" Act, "), (F.lit(1950) + F.col("p_partkey") % 7).cast("string"))
    return p.select(
        F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("dataset_citation_key"), act.alias("act"), F.lit("Section").alias("provision_type"), number.alias("provision_number"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("1")).alias("subsection"), F.concat(F.lit("Text of "), F.col("p_name")).alias("canonical_text"), F.col("p_partkey").alias("line_ord"),
    )


def usable(spark: SparkSession, d: str) -> DataFrame:
    audit = table(spark, d, "part").select(
        F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("dataset_citation_key"), F.when(F.col("p_partkey") % 5 == 4, "INVALID").otherwise("VERIFIED_EXACT").alias("audit_verdict")
    )
    return evidence.usable_evidence(composed_evidence(spark, d), audit)


def composed_claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each line: it cites its part's act, sometimes with another type word, subsection or year.

    The four names of each part's act are composed once, not once a line."""
    flags = F.explode(F.array(*[F.struct(F.lit(a).alias("small"), F.lit(b).alias("later")) for a in (False, True) for b in (False, True)]))
    p = dealt_parts(spark, d, "p_partkey", "p_name", "p_type").select("*", flags.alias("f")).select("p_partkey", "p_name", "p_type", "f.small", "f.later")
    act = F.concat(
        F.lit("the "), F.initcap("p_name"), F.lit(" "), F.initcap(F.when(F.col("small"), F.lit("small")).otherwise(F.lower("p_type"))), F.lit(" Act "),
        (F.lit(1950) + (F.col("p_partkey") + F.col("later").cast("int")) % 7).cast("string"),
    )
    names = p.select("p_partkey", "small", "later", act.alias("act"), T.normal_act(act).alias("norm"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    j = li.join(grown(names), (F.col("l_partkey") == F.col("p_partkey")) & ((F.col("l_suppkey") % 4 == 0) == F.col("small")) & ((F.col("l_suppkey") % 5 == 0) == F.col("later")))
    citation = F.struct(
        F.lit("Section").alias("provision_type"), F.floor(F.col("p_partkey") / 10).cast("string").alias("provision_number"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("1")).when(F.col("l_suppkey") % 3 == 1, F.lit("2")).alias("subsection"),
        F.col("act").alias("act_raw"), F.when(F.col("l_suppkey") % 11 == 0, F.lit("")).otherwise(F.col("norm")).alias("act_norm"),
    )
    return j.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("claim_id"), citation.alias("citation"))


CTE = """
ev AS (
  SELECT 'K' || p_partkey AS k, (p_partkey // 10)::VARCHAR AS num, CASE WHEN p_partkey % 3 = 0 THEN '1' END AS sub, p_partkey AS ord,
    trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name || ' ' || p_type || ' Act, ' || (1950 + p_partkey % 7)), '^the\\s+', ''), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS act
  FROM part WHERE p_partkey % 5 <> 4
), cl AS (
  SELECT l_orderkey AS document_id, l_linenumber AS claim_id, (p_partkey // 10)::VARCHAR AS num,
    CASE l_suppkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS sub,
    CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE lower(p_name || ' ' || CASE WHEN l_suppkey % 4 = 0 THEN 'small' ELSE p_type END || ' act ' || (1950 + (p_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 7)) END AS act,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row
  FROM lineitem JOIN part ON l_partkey = p_partkey
), ex AS (SELECT num, sub, act, max(ord) AS ord FROM ev GROUP BY ALL
), lo AS (SELECT num, act, max(ord) AS ord FROM ev WHERE sub IS NULL GROUP BY ALL
), m0 AS (
  SELECT cl.*, ex.ord AS e1, CASE WHEN cl.sub IS NOT NULL THEN lo.ord END AS e2
  FROM cl LEFT JOIN ex ON cl.num = ex.num AND cl.act = ex.act AND cl.sub IS NOT DISTINCT FROM ex.sub
  LEFT JOIN lo ON cl.num = lo.num AND cl.act = lo.act
), w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(act, '[a-z'']+')), lambda x: length(x) > 2 AND NOT list_contains(['the','of','and','in','for','to','a','an','this','that','act','constitution','india'], x)) AS ws,
    list_distinct(regexp_extract_all(act, '\\b(1[5-9]\\d\\d|20\\d\\d)\\b')) AS ys FROM ev
), v AS (SELECT *, list_filter(list_distinct(regexp_extract_all(act, '[a-z'']+')), lambda x: length(x) > 2 AND NOT list_contains(['the','of','and','in','for','to','a','an','this','that','act','constitution','india'], x)) AS ws,
    list_distinct(regexp_extract_all(act, '\\b(1[5-9]\\d\\d|20\\d\\d)\\b')) AS ys FROM m0 WHERE e1 IS NULL AND e2 IS NULL
), fz AS (
  SELECT v.row, w.ord,
    CASE WHEN len(v.ws) = 0 OR len(w.ws) = 0 THEN 0.0 ELSE len(list_intersect(v.ws, w.ws)) / len(list_distinct(list_concat(v.ws, w.ws)))::DOUBLE END AS score,
    len(v.ys) > 0 AND len(w.ys) > 0 AND len(list_intersect(v.ys, w.ys)) = 0 AS veto
  FROM v JOIN w ON v.num = w.num
), best AS (SELECT row, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, ord) AS r FROM fz WHERE NOT veto) WHERE r = 1
), most AS (SELECT row, max(score) AS most FROM fz GROUP BY row
), matched AS (
  SELECT m0.*, best.score, most.most,
    coalesce(e1, e2, CASE WHEN best.score >= 0.8 THEN best.ord END) AS found,
    CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL THEN 'exact_normalized' WHEN best.score >= 0.8 THEN 'fuzzy' ELSE 'no_evidence' END AS match_method
  FROM m0 LEFT JOIN best USING (row) LEFT JOIN most USING (row)
)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return evidence.match_evidence(composed_claims(spark, d), usable(spark, d))


# ---------------------------------------------------------------- queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('  The ' || p_name || '   ' || p_type || ' Act (ABC), ' || (1950 + p_partkey % 7) || '.'), '^\\s*the\\s+', ''),
  '\\(\\s*[a-z0-9\\s.]{1,20}\\s*\\)', '', 'g'), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS act_norm FROM part""")
def act_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat(F.lit("  The "), "p_name", F.lit("   "), "p_type", F.lit(" Act (ABC), "), (1950 + F.col("p_partkey") % 7).cast("string"), F.lit("."))
    return p.select("p_partkey", T.normal_act(name).alias("act_norm"))


@query("""SELECT 'K' || p_partkey AS dataset_citation_key, p_partkey AS pool_ord FROM part WHERE p_partkey % 5 <> 4""")
def usable_evidence(spark: SparkSession, d: str) -> DataFrame:
    return usable(spark, d).select("dataset_citation_key", "pool_ord")


@query("""WITH b AS (SELECT 'K' || p_partkey AS k, p_partkey AS o FROM part WHERE p_partkey % 5 <> 4),
x AS (SELECT 'K' || (p_partkey + 150) AS k, p_partkey AS o, 'new ' || p_name AS t FROM part WHERE p_size > 25),
mx AS (SELECT max(o) AS m FROM b)
SELECT coalesce(x.k, b.k) AS dataset_citation_key, x.t IS NOT NULL AS replaced, CASE WHEN b.k IS NOT NULL THEN b.o ELSE x.o + m + 1 END AS pool_ord FROM b FULL JOIN x ON b.k = x.k CROSS JOIN mx""")
def evidence_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = usable(spark, d)
    p = table(spark, d, "part").filter("p_size > 25")
    extra = p.select(F.concat(F.lit("K"), (F.col("p_partkey") + 150).cast("string")).alias("dataset_citation_key"), F.concat(F.lit("new "), "p_name").alias("canonical_text"), F.col("p_partkey").alias("pool_ord"))
    out = evidence.overlay(base, extra)
    return out.select("dataset_citation_key", F.startswith("canonical_text", F.lit("new ")).alias("replaced"), "pool_ord")


@query(f"WITH {CTE} SELECT document_id, claim_id, 'K' || coalesce(e1, e2) AS evidence_key FROM matched WHERE coalesce(e1, e2) IS NOT NULL")
def evidence_exact_join(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).filter("match_method = 'exact_normalized'").select("document_id", "claim_id", F.col("evidence.dataset_citation_key").alias("evidence_key"))


@query(f"WITH {CTE} SELECT document_id, claim_id, 'K' || found AS evidence_key, round(score, 6) AS score FROM matched WHERE match_method = 'fuzzy'")
def evidence_fuzzy_top1(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).filter("match_method = 'fuzzy'").select("document_id", "claim_id", F.col("evidence.dataset_citation_key").alias("evidence_key"), F.round("fuzzy_score", 6).alias("score"))


@query(f"""WITH {CTE} SELECT CASE WHEN act = '' THEN 'unresolved_act' WHEN most IS NULL THEN 'provision_absent' WHEN most >= 0.5 AND most < 0.8 THEN 'matching_defect' ELSE 'wrong_act_or_edition' END AS category,
  count(*) AS n FROM matched WHERE match_method = 'no_evidence' GROUP BY 1""")
def no_evidence_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    e = usable(spark, d)
    found = evidence.no_evidence_taxonomy(_matched(spark, d), e)
    return found.filter("no_evidence_category is not null").groupBy(F.col("no_evidence_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CTE} SELECT num AS provision_number, count(*) AS n_claims, count(*) FILTER (WHERE match_method <> 'no_evidence') AS n_with_evidence, count(*) FILTER (WHERE match_method = 'no_evidence') AS n_without_evidence
  FROM matched GROUP BY 1""")
def coverage_by_group(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).withColumn("provision_number", F.col("citation.provision_number"))
    return evidence.coverage(m, "provision_number").drop("coverage_pct")


@query(f"""WITH {CTE}, t AS (SELECT document_id, num, count(DISTINCT act) FILTER (WHERE act <> '') AS n FROM cl GROUP BY ALL)
SELECT cl.document_id, cl.claim_id, t.n >= 2 AS ambiguous FROM cl JOIN t ON cl.document_id = t.document_id AND cl.num = t.num""")
def ambiguous_numbers(spark: SparkSession, d: str) -> DataFrame:
    return evidence.ambiguous_numbers(composed_claims(spark, d)).select("document_id", "claim_id", "ambiguous")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Gold and two arms' labels with scores, from lines."""
    li = table(spark, d, "lineitem")
    labels = F.array(*[F.lit(x) for x in S.LABELS])
    a = F.pmod(F.col("l_partkey"), F.lit(100)) / 100.0
    b = F.pmod(F.col("l_suppkey") * 7, F.lit(60)) / 100.0 * (1 - a)
    scores = F.create_map(F.lit("entailment"), F.round(a, 4), F.lit("neutral"), F.round(b, 4), F.lit("contradiction"), F.round(1 - a - b, 4))
    pick = lambda e: F.get(labels, (e % 3).cast("int"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        pick(F.col("l_partkey")).alias("expected_label"),
        pick(F.col("l_partkey") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).alias("first"),
        F.when(F.col("l_suppkey") % 17 != 0, pick(F.col("l_partkey") + F.when(F.col("l_suppkey") % 7 == 0, 2).otherwise(0))).alias("second"),
        scores.alias("raw_scores"), "l_returnflag", "l_quantity",
    )


PRED = """p AS (
  SELECT l_orderkey, ['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION'][l_partkey % 3 + 1] AS gold,
    ['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION'][(l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS first,
    CASE WHEN l_suppkey % 17 <> 0 THEN ['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION'][(l_partkey + CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 0 END) % 3 + 1] END AS second,
    round((l_partkey % 100) / 100.0::DOUBLE, 4) AS pe, round((l_suppkey * 7 % 60) / 100.0::DOUBLE * (1 - (l_partkey % 100) / 100.0::DOUBLE), 4) AS pn,
    round(1 - (l_partkey % 100) / 100.0::DOUBLE - (l_suppkey * 7 % 60) / 100.0::DOUBLE * (1 - (l_partkey % 100) / 100.0::DOUBLE), 4) AS pc, l_returnflag, l_quantity
  FROM lineitem)"""


@query(f"""WITH {PRED}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
s AS (SELECT threshold, gold, greatest(pe, pn, pc) AS c, CASE WHEN pe >= pn AND pe >= pc THEN 'ENTAILED' WHEN pn >= pc THEN 'NOT_ENOUGH_INFORMATION' ELSE 'CONTRADICTED' END AS l FROM p CROSS JOIN t)
SELECT threshold, gold, CASE WHEN c < threshold THEN 'NOT_ENOUGH_INFORMATION' ELSE l END AS predicted, count(*) AS n, count(*) FILTER (WHERE c < threshold) AS n_low FROM s GROUP BY 1, 2, 3""")
def verdict_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.threshold_sweep(_predictions(spark, d), [0.5, 0.6, 0.7, 0.8, 0.9])


@query(f"""WITH {PRED}, s AS (SELECT gold, coalesce(second, 'INFERENCE_FAILURE') AS predicted FROM p),
g AS (SELECT unnest(['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION']) AS gold), q AS (SELECT gold AS predicted FROM g)
SELECT gold, predicted, sum(n)::BIGINT AS n FROM (SELECT gold, predicted, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT gold, predicted, 0 FROM g CROSS JOIN q) GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, d), "expected_label", "second")


@query(f"""WITH {PRED}, l AS (SELECT unnest(['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION']) AS label),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND second = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE second = label) AS called FROM p CROSS JOIN l GROUP BY label)
SELECT label, support, round(CASE WHEN called = 0 THEN 0 ELSE tp / called::DOUBLE END, 6) AS "precision", round(CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (called + support) END::DOUBLE, 6) AS f1 FROM c""")
def prf1(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.per_class(metrics.confusion(_predictions(spark, d), "expected_label", "second"))
    return m.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_F1 = """c AS (SELECT {by} label, count(*) FILTER (WHERE gold = label AND first = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE first = label) AS called FROM p CROSS JOIN l GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (called + support) END::DOUBLE AS f1 FROM c)"""


@query(f"""WITH {PRED}, l AS (SELECT unnest(['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION']) AS label), {_F1.format(by='l_returnflag,')}
SELECT f.l_returnflag, any_value(n) AS n, round(any_value(acc), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1
FROM f JOIN (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE gold = first) / count(*)::DOUBLE AS acc FROM p GROUP BY 1) a ON f.l_returnflag = a.l_returnflag GROUP BY 1""")
def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.summary(metrics.confusion(_predictions(spark, d), "expected_label", "first", "l_returnflag"), "l_returnflag")
    return m.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(f"""WITH {PRED} SELECT CASE WHEN first IS NOT DISTINCT FROM second AND first = 'NOT_ENOUGH_INFORMATION' THEN 'both_abstain' WHEN first IS NOT DISTINCT FROM second THEN 'both_agree'
  WHEN second IS NOT DISTINCT FROM gold THEN 'v2_improves' WHEN first = gold THEN 'v2_changes_correct_to_incorrect' ELSE 'both_fail' END AS category, count(*) AS n FROM p GROUP BY 1""")
def paired_categories(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return p.groupBy(metrics.paired_category(F.col("expected_label"), F.col("first"), F.col("second")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRED}, q AS (SELECT l_orderkey % 500 AS g, count(*) FILTER (WHERE gold = first AND gold IS DISTINCT FROM second) AS first_only, count(*) FILTER (WHERE gold <> first AND gold IS NOT DISTINCT FROM second) AS second_only FROM p GROUP BY 1)
SELECT g, first_only, second_only, round(CASE WHEN first_only + second_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(first_only, second_only) + 1),
  lambda i: exp(lgamma(first_only + second_only + 1) - lgamma(i + 1) - lgamma(first_only + second_only - i + 1) - (first_only + second_only) * ln(2))))) END::DOUBLE, 6) AS p_exact,
  round(CASE WHEN first_only + second_only = 0 THEN 0 ELSE (abs(first_only - second_only) - 1.0) ^ 2 / (first_only + second_only) END::DOUBLE, 6) AS chi2 FROM q""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).withColumnRenamed("expected_label", "gold").withColumn("g", F.split("id", "-")[0].cast("long") % 500)
    return metrics.mcnemar(p, "g").select("g", "first_only", "second_only", F.round("p_exact", 6).alias("p_exact"), F.round("chi2", 6).alias("chi2"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n::DOUBLE AS p FROM c)
SELECT l_suppkey, n, k, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))::DOUBLE, 6) AS low,
  round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))::DOUBLE, 6) AS high FROM z""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return c.select("l_suppkey", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1""")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = metrics.quantiles(table(spark, d, "events"), "value", (0.1, 0.25, 0.5, 0.75, 0.9), "event_type")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "p25", "p50", "p75", "p90", "mean")], "n")


@query("""SELECT event_type, grouping(event_type) = 1 AS is_total, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY ROLLUP (event_type)""")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.confidence_stats(table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "is_total", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "min", "max")


@query("""SELECT CASE WHEN v < 0.6 THEN 0 WHEN v < 0.7 THEN 1 WHEN v < 0.8 THEN 2 WHEN v < 0.9 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM (SELECT l_discount * 10 AS v FROM lineitem) WHERE v >= 0.5 AND v <= 1.0 GROUP BY 1""")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("v")), "v")


@query(f"""WITH {PRED} SELECT CASE WHEN first IS NOT DISTINCT FROM second THEN 'unchanged' ELSE 'changed_' || lower(first) || '_to_' || lower(second) END AS transition, count(*) AS n FROM p GROUP BY 1""")
def verdict_transitions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transitions(_predictions(spark, d), "first", "second")


@query(f"""WITH {CTE} SELECT document_id, count(*) AS n_citations_parsed, count(*) FILTER (WHERE match_method = 'exact_normalized') AS n_matched_exact, count(*) FILTER (WHERE match_method = 'fuzzy') AS n_matched_fuzzy,
  count(*) FILTER (WHERE match_method = 'no_evidence') AS n_no_evidence, count(DISTINCT (e.act, e.num)) FILTER (WHERE e.k IS NOT NULL) AS n_distinct_evidence_pairs, count(DISTINCT e.act) AS n_distinct_acts_matched,
  3 * count(*) FILTER (WHERE match_method = 'exact_normalized') + 2 * count(*) FILTER (WHERE match_method = 'fuzzy') + 2 * count(DISTINCT (e.act, e.num)) FILTER (WHERE e.k IS NOT NULL) + count(*) FILTER (WHERE match_method <> 'no_evidence') AS score
FROM matched LEFT JOIN ev e ON matched.found = e.ord GROUP BY 1""")
def candidate_scorecard(spark: SparkSession, d: str) -> DataFrame:
    s = selection.scorecard(_pairs(spark, d))
    return s.drop("matched_pairs", "substantive_matches", "procedural_matches", "is_purely_procedural")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("document_id", "match_method", T.normal_act(F.col("evidence.act")).alias("act_norm"), F.col("evidence.provision_number").alias("provision_number"))


@query(f"""WITH {CTE}, s AS (SELECT document_id, list_distinct(list((e.act, e.num)) FILTER (WHERE e.k IS NOT NULL)) AS pairs, 3 * count(*) FILTER (WHERE match_method = 'exact_normalized') + 2 * count(*) FILTER (WHERE match_method = 'fuzzy')
  + 2 * count(DISTINCT (e.act, e.num)) FILTER (WHERE e.k IS NOT NULL) + count(*) FILTER (WHERE match_method <> 'no_evidence') AS score FROM matched LEFT JOIN ev e ON matched.found = e.ord GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(len(pairs), 0) DESC, document_id) AS r FROM s),
f AS (SELECT min(r) AS r FROM (SELECT r, unnest(pairs) AS p FROM o) GROUP BY p), dv AS (SELECT DISTINCT r FROM f)
SELECT document_id, score, place FROM (SELECT o.document_id, o.score, row_number() OVER (ORDER BY dv.r IS NULL, o.r) AS place FROM o LEFT JOIN dv ON o.r = dv.r) WHERE place <= 50""")
def diversity_first(spark: SparkSession, d: str) -> DataFrame:
    top = selection.top_cases(selection.scorecard(_pairs(spark, d)), 50)
    return top.select("document_id", "score", F.col("place").cast(LONG).alias("place"))


@query("""SELECT CASE WHEN pri = '1-URGENT' THEN 'previously_evaluated' WHEN k = 0 THEN 'no_citations' WHEN m = 0 THEN 'no_evidence' ELSE 'eligible' END AS reason, count(*) AS n
FROM (SELECT o_orderkey, o_orderpriority AS pri, o_custkey % 4 AS k, count(l_orderkey) FILTER (WHERE l_quantity > 40) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1""")
def exclusion_funnel(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").filter("l_quantity > 40").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_matched_exact"))
    o = table(spark, d, "orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cases = o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 4).alias("n_raw_citation_keys"), F.coalesce("n_matched_exact", F.lit(0)).alias("n_matched_exact"), F.lit(0).alias("n_matched_fuzzy"))
    return selection.funnel(cases, o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id")))


@query("""SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    g = review.duplicate_groups(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], "doc_id")
    return g.select("h", "n", F.get("ids", F.lit(0)).alias("first_id"))


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_previously_seen(spark: SparkSession, d: str) -> DataFrame:
    return selection.anti_seen(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = dealt_parts(spark, d, "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    text = F.concat(F.lit("Whoever keeps a "), F.col("p_name"), F.lit(" of "), F.lower("p_type"), F.lit(" make shall be punished with imprisonment which may extend to "), F.col("p_size").cast("string"), F.lit(" years."))
    return p.select(
        F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("dataset_citation_key"), F.col("p_partkey").alias("pool_ord"), text.alias("canonical_text"), F.lit("Section").alias("provision_type"),
        F.col("p_size").cast("string").alias("provision_number"), F.lit(None).cast("string").alias("subsection"), F.col("p_brand").alias("act"), F.lower("p_brand").alias("act_norm"), F.lit("VERIFIED_EXACT").alias("audit_verdict"),
    )


_REC = """r AS (SELECT p_partkey, count(*) OVER () AS n, 'Whoever keeps a ' || p_name || ' of ' || lower(p_type) || ' make shall be punished with imprisonment which may extend to ' || p_size || ' years.' AS t, p_size, p_brand FROM part)"""


@query("""WITH w AS (SELECT p_partkey, count(*) OVER () AS n, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+')) AS ws FROM part),
x AS (SELECT a.p_partkey, b.p_partkey AS o, s.i FROM w a CROSS JOIN (SELECT unnest([17,23,29,31,37,41,43,47,53]) AS s, generate_subscripts([17,23,29,31,37,41,43,47,53], 1) AS i) s JOIN w b ON (a.p_partkey + s.s) % a.n = b.p_partkey
  WHERE a.p_partkey <> b.p_partkey AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE < 0.35)
SELECT p_partkey AS pool_ord, 'K' || arg_min(o, i) AS partner FROM x GROUP BY 1""")
def nei_partner(spark: SparkSession, d: str) -> DataFrame:
    short = table(spark, d, "part").select(
        F.col("p_partkey").alias("pool_ord"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("dataset_citation_key"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("canonical_text")
    )
    return benchmarks.partners(short).select("pool_ord", F.col("partner.o_key").alias("partner"))


@query(f"""WITH {_REC} SELECT 'K' || p_partkey AS evidence_key, unnest([
  'Any person' || substr(replace(replace(t, 'shall be punished with', 'is liable to punishment of'), 'may extend to', 'may go up to'), 8), 'x']) AS h FROM r""".replace("'Any person' ||", "'Any person who' ||").replace(", 'x']", "]"))
def benchmark_paraphrase(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select(F.col("dataset_citation_key").alias("evidence_key"), benchmarks.paraphrased(F.col("canonical_text"))["text"].alias("h"))


@query(f"""WITH {_REC} SELECT 'K' || p_partkey AS evidence_key, replace(t, 'shall be punished with', 'shall not be punished with') AS h FROM r""")
def benchmark_negation(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select(F.col("dataset_citation_key").alias("evidence_key"), benchmarks.negated(F.col("canonical_text"))["text"].alias("h"))


@query(f"""WITH {_REC} SELECT 's' || (p_partkey + 1) AS claim_id, 'Section ' || p_size || ' of ' || p_brand || ' makes this action an absolute, non-discretionary legal duty that must always be carried out, with no discretion permitted.' AS claim_text, 'may_to_must' AS transform_rule FROM r""")
def stress_claims(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.stress_claims(_records(spark, d)).select("claim_id", "claim_text", "transform_rule")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q CROSS JOIN embeddings e)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e.filter("vec_id % 50 = 0"), e, 5)


@query("""WITH d AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS doc FROM part), dt AS (SELECT doc, list_filter(list_distinct(regexp_extract_all(doc, '[a-z'']+')), lambda x: length(x) > 2 AND x NOT IN ('the','of','and','in','for','to','a','an','this','that','act','constitution','india')) AS ts FROM d),
n AS (SELECT count(*) AS n, avg(len(ts)) AS ml FROM dt), t AS (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM dt), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df CROSS JOIN n), i1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
w AS (SELECT doc, t.term, idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / ml)) AS weight FROM t JOIN i1 ON t.term = i1.term CROSS JOIN n),
q AS (SELECT DISTINCT p_name AS query, unnest(list_distinct(regexp_extract_all(p_name, '[a-z'']+'))) AS term FROM part)
SELECT query, doc, round(sum(weight), 6) AS score FROM q JOIN w ON q.term = w.term WHERE length(q.term) > 2 GROUP BY 1, 2""")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    index = retrieval.bm25_index(p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("act_norm")))
    return retrieval.bm25_scores(p.select(F.col("p_name").alias("query")).distinct(), index).select("query", "doc", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, role, min(turn) AS first_ord, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1, 2""")
def claims_by_turn(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("role").alias("claim_text"), F.col("turn").alias("claim_ord"), F.col("turn").cast("string").alias("claim_id"))
    g = claims.claims_by_sentence(c)
    return g.select(F.col("document_id").alias("conv_id"), F.col("claim_text").alias("role"), "first_ord", F.array_join("claim_ids", ",").alias("turns"))


@query("""WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_type = 'error' AS err, event_type IN ('error', 'purchase') AS fin FROM events),
s AS (SELECT *, coalesce(max(fin::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
g AS (SELECT run_id, count(*) AS n_events, min(seq) FILTER (WHERE ended = 1) AS first_bad_seq, min(seq) FILTER (WHERE fin) AS end_seq, bool_or(fin AND err) AS er FROM s GROUP BY 1)
SELECT run_id, n_events, CASE WHEN first_bad_seq IS NOT NULL THEN 'protocol_error' WHEN end_seq IS NULL THEN 'open' WHEN er THEN 'failed' ELSE 'complete' END AS state, first_bad_seq FROM g""")
def stage_state_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "run").otherwise("claims")
    events = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.lit("complete").alias("status"))
    return stages.run_states(events)


@query("""SELECT status, count(*) AS n, CASE status WHEN 'corrected' THEN 'none (shipped)' WHEN 'correction_failed' THEN 'reverification' WHEN 'not_triggered' THEN 'none (correctly not triggered)' WHEN 'correction_sibling_regression' THEN 'safety_sibling_regression' ELSE 'safety_scope_citation_ordinal' END AS stage
FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'not_triggered' WHEN l_suppkey % 5 = 0 THEN 'correction_scope_violation' WHEN l_suppkey % 7 = 0 THEN 'correction_unauthorized_addition' WHEN l_partkey % 3 <> 0 THEN 'correction_failed'
  WHEN l_partkey % 2 = 0 THEN 'correction_sibling_regression' ELSE 'corrected' END AS status FROM lineitem) GROUP BY status""")
def correction_gates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    g = li.select(
        (F.col("l_linenumber") % 2 != 0).alias("flagged"), F.lit(True).alias("by_span"), (F.col("l_suppkey") % 5 != 0).alias("siblings_kept"), F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0).alias("n_new"),
        F.when(F.col("l_partkey") % 3 == 0, S.ENTAILED).otherwise(S.NEI).alias("reverified"), F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(0).alias("n_regressions"),
    )
    s = g.select(gates.status(g).alias("status"))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", gates.first_failure_stage(F.col("status")))


@query("""SELECT l_orderkey, l_linenumber, contains(t, f) AND NOT regexp_matches(t, '[0-9]' || f) AND NOT regexp_matches(t, f || '[0-9]') AS present FROM
  (SELECT l_orderkey, l_linenumber, 'Section ' || l_suppkey || ' and ' || l_linenumber AS t, l_linenumber::VARCHAR AS f FROM lineitem WHERE l_linenumber::VARCHAR <> l_suppkey::VARCHAR)""".replace(" WHERE l_linenumber::VARCHAR <> l_suppkey::VARCHAR", "").replace("contains(t, f) AND NOT regexp_matches(t, '[0-9]' || f) AND NOT regexp_matches(t, f || '[0-9]')", "regexp_matches(t, '\\b' || f || '\\b')"))
def fragment_check(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    t = F.concat(F.lit("Section "), F.col("l_suppkey").cast("string"), F.lit(" and "), F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", T.fragment_present(F.col("l_linenumber").cast("string"), t).alias("present"))


@query("""SELECT 'Section ' || p_size || ', 12(a) & 7 of the ' || p_brand AS reference, '[' || array_to_string(list_sort(list_distinct(['section ' || p_size, 'section 12(a)', 'section 7'])), ', ') || ']' AS keys FROM (SELECT DISTINCT p_size, p_brand FROM part)""")
def reference_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_size", "p_brand").distinct()
    r = F.concat(F.lit("Section "), F.col("p_size").cast("string"), F.lit(", 12(a) & 7 of the "), F.col("p_brand"))
    keys = F.array_sort(F.transform(review.provision_keys(r), lambda k: F.concat(k["kind"], F.lit(" "), k["number"])))
    return p.select(r.alias("reference"), F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"))


@query("""SELECT 'missing text' AS "check", count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n FROM documents UNION ALL SELECT 'unknown lang', count(*) FILTER (WHERE lang NOT IN ('en', 'de')) FROM documents
UNION ALL SELECT 'repeated doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return io.quality_checks(docs, "doc_id", ["text"], {"lang": ["en", "de"]}).select("check", "n")


@query("""SELECT array_to_string(list_slice(string_split(text, ' '), greatest(len(string_split(text, ' ')) - 99, 1), len(string_split(text, ' '))), ' ') AS tail, doc_id FROM documents""")
def last_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.last_tokens(F.col("text"), 100).alias("tail"))


@query("""WITH o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 3), n AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.01)
SELECT CASE WHEN o.l_partkey IS NULL THEN 'added' WHEN n.l_partkey IS NULL THEN 'removed' ELSE 'kept' END AS change, count(*) AS n FROM o FULL JOIN n ON o.l_partkey = n.l_partkey GROUP BY 1""")
def key_versions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return reports.key_versions(li.filter("l_quantity < 3"), li.filter("l_discount < 0.01"), "l_partkey")


def _arm(spark: SparkSession, d: str, shift: int) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    v = F.get(F.array(*[F.lit(x) for x in S.LABELS]), ((F.col("p") + F.when(F.col("p") % 5 == 0, shift).otherwise(0)) % 3).cast("int"))
    m = F.when((F.col("p") + shift) % 4 == 0, "no_evidence").otherwise("fuzzy")
    return li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("claim_ord"), F.lit("t").alias("claim_text"), m.alias("match_method"), v.alias("verdict"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL), l AS (SELECT ['entailed','contradicted','not_enough_information'] AS ls),
x AS (SELECT p % 4 <> 0 AS a, (p + 1) % 4 <> 0 AS b, ls[p % 3 + 1] AS v, ls[(p + CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS w FROM g CROSS JOIN l)
SELECT CASE WHEN NOT a AND b THEN 'evidence_gained' WHEN a AND NOT b THEN 'evidence_lost' ELSE 'evidence_unchanged' END AS evidence_change,
  CASE WHEN v = w THEN 'verdict_unchanged' ELSE 'changed_' || v || '_to_' || w END AS verdict_change, count(*) AS n FROM x GROUP BY ALL""")
def change_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reports.change_matrix(reports.zipped_arms(_arm(spark, d, 0), _arm(spark, d, 1)))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS x FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
c AS (SELECT coalesce(y, 0) - coalesce(x, 0) AS dl FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey)
SELECT count(*) FILTER (WHERE dl > 0) AS n_more, count(*) FILTER (WHERE dl < 0) AS n_fewer, count(*) FILTER (WHERE dl = 0) AS n_same, sum(dl)::BIGINT AS net FROM c""")
def parser_comparison(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return reports.parser_comparison(li.filter("l_returnflag <> 'A'"), li.filter("l_returnflag <> 'N'"), "l_orderkey").drop("p_sign")


@query("""SELECT l_shipmode AS mode, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen)::INTEGER AS rank FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1)""")
def ranked_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked_counts(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "mode"), "mode", "l_orderkey")


@query(f"""WITH {PRED} SELECT l_returnflag AS batch, count(*) AS n_claims, count(*) FILTER (WHERE pe > 0.2) AS n_with_evidence, count(*) FILTER (WHERE first = 'ENTAILED') AS n_entailed, count(*) FILTER (WHERE first = 'CONTRADICTED') AS n_contradicted,
  count(*) FILTER (WHERE first = 'NOT_ENOUGH_INFORMATION') AS n_not_enough_information, 0::BIGINT AS n_no_evidence, round(avg(pe), 6) AS mean_confidence, round(quantile_cont(pe, 0.5), 6) AS median_confidence FROM p GROUP BY 1""")
def batch_table(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    e = F.col("raw_scores")["entailment"]
    c = p.select(F.col("l_returnflag").alias("batch"), F.when(e > 0.2, "fuzzy").otherwise("no_evidence").alias("match_method"), F.col("first").alias("verdict"), e.alias("confidence"))
    b = reports.batch_table(c)
    return b.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("median_confidence", F.round("median_confidence", 6))


@query("""SELECT l_orderkey % 10 AS g, round(p1 - p2, 6) AS delta, round((p1 - p2) / sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)), 6) AS z FROM (SELECT l_orderkey % 10 AS l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS n1, count(*) FILTER (WHERE l_linestatus = 'F') AS n2,
  count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') / count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS p1, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') / count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS p2,
  count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS pool FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY 1)""")
def two_proportion_z(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_linestatus in ('O', 'F')")
    o, r = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    c = li.groupBy((F.col("l_orderkey") % 10).alias("g")).agg(F.count_if(o & r).alias("x1"), F.count_if(o).alias("n1"), F.count_if(~o & r).alias("x2"), F.count_if(~o).alias("n2"))
    z = stats.two_proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    return c.select("g", F.round(F.col("x1") / F.col("n1") - F.col("x2") / F.col("n2"), 6).alias("delta"), F.round(z["z"], 6).alias("z"))


@query("""SELECT count(*) AS n_checked, count(*) FILTER (WHERE contains('Section ' || l_partkey || ' and ' || l_suppkey || '.', 'Section ' || l_suppkey)) AS n_sentence_kept,
  count(*) FILTER (WHERE contains('Section ' || l_partkey || ' and ' || l_suppkey || '.', l_suppkey::VARCHAR) AND contains('Section ' || l_partkey || ' and ' || l_suppkey || '.', l_linenumber::VARCHAR)) AS n_spans_kept FROM lineitem""")
def preservation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return reports.preservation(li.select(F.concat(F.lit("Section "), s("l_partkey"), F.lit(" and "), s("l_suppkey"), F.lit(".")).alias("corrected_text"), F.concat(F.lit("Section "), s("l_suppkey")).alias("claim_text"), F.array(s("l_suppkey"), s("l_linenumber")).alias("assertion_spans")))


__all__ = ["ORACLE_SQL", "QUERIES"]
