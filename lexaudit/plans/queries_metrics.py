"""Queries of metrics, resampling, baselines and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.operators import bootstrap, learning, metrics, quantiles, reports, verdicts
from lexaudit.plans.queries import PRED, _predictions, query
from lexaudit.session import table

_L = "l AS (SELECT unnest(['ENTAILED','CONTRADICTED','NOT_ENOUGH_INFORMATION']) AS label)"


@query(f"""WITH {PRED}, {_L}, q AS (SELECT * FROM p WHERE gold <> 'CONTRADICTED'),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND first = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE first = label) AS called FROM q CROSS JOIN l GROUP BY label),
f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (called + support) END::DOUBLE AS f1 FROM c) SELECT round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1_present FROM f""")
def macro_over_present(spark: SparkSession, d: str) -> DataFrame:
    rows = _predictions(spark, d).filter(F.col("expected_label") != S.CONTRADICTED)
    s = metrics.summary(metrics.confusion(rows, "expected_label", "first"))
    return s.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("macro_f1_present", 6).alias("macro_f1_present"))


@query(f"""WITH {PRED}, s AS (SELECT gold, coalesce(second, 'NOT_ENOUGH_INFORMATION') AS predicted FROM p), {_L}
SELECT gold, predicted, sum(n)::BIGINT AS n FROM (SELECT gold, predicted, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT a.label, b.label, 0 FROM l a CROSS JOIN l b) GROUP BY ALL""")
def lenient_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, d), "expected_label", "second", lenient=True)


_STRATA = "st AS (SELECT unnest(['ALL', CASE WHEN l_quantity > 25 THEN 'attributed' ELSE 'non_attributed' END, 'condition:' || CASE WHEN l_returnflag = 'A' THEN 'none' ELSE l_returnflag END]) AS stratum, gold, first FROM p)"


@query(f"WITH {PRED}, {_STRATA} SELECT stratum, count(*) AS n, round(avg((gold = first)::INTEGER), 6) AS accuracy FROM st GROUP BY 1")
def strata_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy in all, by attribution, and by condition; a null condition is one."""
    p = _predictions(spark, d).withColumn("c", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))).withColumn("a", F.col("l_quantity") > 25)
    s = metrics.summary(metrics.confusion(metrics.strata(p, "c", "a"), "expected_label", "first", "stratum"), "stratum")
    return s.select("stratum", "n", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH r AS (SELECT ['Yes','No','Partially'][l_partkey % 3 + 1] AS gold, ['Yes','No','Partially'][(l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS said FROM lineitem), l AS (SELECT unnest(['Yes','No','Partially']) AS label),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND said = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE said = label) AS called FROM r CROSS JOIN l GROUP BY label)
SELECT round(avg(tp / called::DOUBLE), 6) AS macro_precision, round(avg(tp / support::DOUBLE), 6) AS macro_recall, round(avg(2.0 * tp / (called + support))::DOUBLE, 6) AS macro_f1 FROM c""")
def review_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against reviewers' labels."""
    labels = ("Yes", "No", "Partially")
    pick = lambda e: F.get(F.array(*[F.lit(x) for x in labels]), (e % 3).cast("int"))
    rows = table(spark, d, "lineitem").select(pick(F.col("l_partkey")).alias("gold"), pick(F.col("l_partkey") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).alias("said"))
    s = metrics.summary(metrics.confusion(rows, "gold", "said", labels=labels), labels=labels)
    return s.select(*[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query("""WITH p AS (SELECT 0.5 + 0.05 * l_linenumber AS t, round(avg(l_partkey % 10 / 10.0::DOUBLE) * 50) / 100 AS v FROM lineitem GROUP BY l_linenumber), b AS (SELECT max(v) AS m FROM p)
SELECT round(min(t) FILTER (WHERE v = m), 6)::DOUBLE AS best_threshold, round(any_value(m), 6) AS best_value, round(min(t) FILTER (WHERE v >= m - 0.005), 6)::DOUBLE AS plateau_from, round(max(t) FILTER (WHERE v >= m - 0.005), 6)::DOUBLE AS plateau_to,
  round(any_value(m) - max(v) FILTER (WHERE abs(t - 0.7) < 1e-9), 6) AS gap_to_production FROM p CROSS JOIN b""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    value = F.round(F.avg((F.col("l_partkey") % 10) / 10.0) * 50) / 100
    points = table(spark, d, "lineitem").groupBy("l_linenumber").agg(value.alias("macro_f1")).withColumn("threshold", 0.5 + 0.05 * F.col("l_linenumber"))
    b = metrics.best_threshold(points)
    return b.select(*[F.round(c, 6).alias(c) for c in ("best_threshold", "best_value", "plateau_from", "plateau_to", "gap_to_production")])


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY 1""")
def value_spread(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.spread(table(spark, d, "events"), "value", "event_type")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")])


_IDS = PRED.replace("SELECT l_orderkey,", "SELECT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,")


@query(f"WITH {_IDS} SELECT gold AS expected_label, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY id) AS rank FROM p WHERE gold IS DISTINCT FROM second) WHERE rank <= 3")
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_failures(_predictions(spark, d), predicted="second").select("expected_label", "id", "rank")


@query(f"WITH {_IDS} SELECT DISTINCT id, gold, first, second FROM p")
def paired_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).dropDuplicates(["id"])
    return metrics.paired(p.withColumnRenamed("first", "predicted_label"), p.withColumnRenamed("second", "predicted_label"))


@query(f"""WITH {PRED}, q AS (SELECT l_returnflag, count(*) FILTER (WHERE gold = first AND gold IS DISTINCT FROM second) AS first_only, count(*) FILTER (WHERE gold <> first AND gold IS NOT DISTINCT FROM second) AS second_only FROM p WHERE gold = 'CONTRADICTED' GROUP BY 1)
SELECT l_returnflag, first_only, second_only, round((abs(first_only - second_only) - 1.0) ^ 2 / (first_only + second_only)::DOUBLE, 6) AS chi2 FROM q""")
def class_recall_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d).withColumnRenamed("expected_label", "gold")
    return metrics.mcnemar(p, "l_returnflag", target=S.CONTRADICTED).select("l_returnflag", "first_only", "second_only", F.round("chi2", 6).alias("chi2"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), z AS (SELECT *, 1.96::DOUBLE AS z, k / n::DOUBLE AS p FROM c)
SELECT l_suppkey, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))::DOUBLE, 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))::DOUBLE, 6) AS high FROM z""")
def wilson_rounded(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"), stats.Z_ROUNDED)
    return c.select("l_suppkey", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""SELECT o_orderkey, CASE WHEN lo > 0 THEN 'improved' WHEN hi < 0 THEN 'degraded' WHEN lo + hi = 0 THEN 'unchanged' ELSE 'inconclusive' END AS verdict FROM (SELECT o_orderkey, o_custkey % 5 - 3 AS lo, o_custkey % 5 - 3 + o_orderkey % 3 AS hi FROM orders)""")
def change_verdicts(spark: SparkSession, d: str) -> DataFrame:
    lo = F.col("o_custkey") % 5 - 3
    hi = lo + F.col("o_orderkey") % 3
    return table(spark, d, "orders").select("o_orderkey", stats.change_verdict(lo, hi, (lo + hi) / 2).alias("verdict"))


_CASES = """c AS (SELECT o_orderkey, o_custkey % 7 AS n_claims, (o_custkey % 7) // 2 AS n_ev, CASE o_orderkey % 4 WHEN 0 THEN 'not_triggered' WHEN 1 THEN 'corrected' ELSE 'correction_failed' END AS status, round(o_totalprice / 1000) AS seconds FROM orders)"""


def half_even(x: str, digits: int) -> str:
    return f"round_even({x}, {digits})"


@query(f"""WITH {_CASES} SELECT count(*) AS n_cases, sum(n_claims)::BIGINT AS n_claims, count(*) FILTER (WHERE status <> 'not_triggered') AS n_triggered, count(*) FILTER (WHERE status = 'corrected') AS n_corrected,
{half_even("100.0 * sum(n_ev)::DOUBLE / sum(n_claims)", 1)} AS coverage_pct, {half_even("avg(n_claims)", 2)} AS claims_per_case, {half_even("100.0 * count(*) FILTER (WHERE status = 'corrected') / (count(*) FILTER (WHERE status <> 'not_triggered'))::DOUBLE", 1)} AS corrected_pct,
{half_even("avg(seconds)", 2)} AS mean_seconds, {half_even("quantile_cont(seconds, 0.5)", 2)} AS median_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds, sum(seconds) AS total_seconds FROM c""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 7
    status = F.when(F.col("o_orderkey") % 4 == 0, "not_triggered").when(F.col("o_orderkey") % 4 == 1, "corrected").otherwise("correction_failed")
    cases = table(spark, d, "orders").select(k.alias("n_claims"), F.floor(k / 2).alias("n_with_evidence"), status.alias("status"), F.round(F.col("o_totalprice") / 1000).alias("seconds"))
    return metrics.run_summary(cases)


_ARMS = """a AS (SELECT ['bare', 'labeled'][l_suppkey % 2 + 1] AS framing, l_partkey % 3 = 0 AS clean, l_partkey % 4 <> 0 AS matched, CASE WHEN (l_partkey + l_suppkey) % 5 < 3 THEN 'CONTRADICTED' ELSE 'ENTAILED' END AS verdict,
  CASE WHEN l_partkey % 7 = 0 THEN 'corrected' ELSE 'correction_failed' END AS status, CASE WHEN l_suppkey % 9 = 0 THEN 'CONTRADICTED' ELSE 'ENTAILED' END AS reverified FROM lineitem)"""


@query(f"""WITH {_ARMS}, c AS (SELECT *, verdict = 'CONTRADICTED' AS hit FROM a) SELECT framing, count(*) FILTER (WHERE NOT clean) AS n_planted, count(*) FILTER (WHERE NOT clean AND hit) AS n_detected,
round(count(*) FILTER (WHERE NOT clean AND hit) / (count(*) FILTER (WHERE NOT clean))::DOUBLE, 6) AS recall, count(*) FILTER (WHERE NOT clean AND matched) AS n_matched,
round(count(*) FILTER (WHERE NOT clean AND matched AND hit) / (count(*) FILTER (WHERE NOT clean AND matched))::DOUBLE, 6) AS recall_matched, round(count(*) FILTER (WHERE clean AND hit) / (count(*) FILTER (WHERE clean))::DOUBLE, 6) AS false_positive_rate,
count(*) FILTER (WHERE status = 'corrected' AND reverified <> 'ENTAILED') AS n_unsafe_shipped FROM c GROUP BY 1""")
def stress_arms(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        F.when(s % 2 == 0, "bare").otherwise("labeled").alias("framing"), (p % 3 == 0).alias("clean"), (p % 4 != 0).alias("matched"), F.when((p + s) % 5 < 3, S.CONTRADICTED).otherwise(S.ENTAILED).alias("verdict"),
        F.when(p % 7 == 0, "corrected").otherwise("correction_failed").alias("status"), F.when(s % 9 == 0, S.CONTRADICTED).otherwise(S.ENTAILED).alias("reverified"),
    )
    a = metrics.stress_arms(rows)
    return a.select(*[F.round(c, 6).alias(c) if c in ("recall", "recall_matched", "false_positive_rate") else F.col(c) for c in a.columns])


@query("""WITH c AS (SELECT l_orderkey AS item, ['bare', 'labeled'][l_suppkey % 2 + 1] AS framing, l_partkey % 2 = 0 AS narrow, l_linenumber AS ord, l_partkey % 9 = l_orderkey % 9 AS planted, l_partkey * 100000 + l_suppkey AS pk, CASE WHEN l_suppkey % 3 = 0 THEN 'CONTRADICTED' ELSE 'ENTAILED' END AS verdict, l_suppkey % 5 = 0 AS none FROM lineitem),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, framing, narrow ORDER BY planted DESC, ord, pk) AS r FROM c) WHERE r = 1),
s AS (SELECT framing, narrow, count(*) AS n, count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS k, count(*) FILTER (WHERE verdict = 'CONTRADICTED' AND NOT none) AS km FROM t GROUP BY ALL)
SELECT framing, narrow, n, k AS n_detected, km AS n_detected_matched, round(k / n::DOUBLE, 6) AS recall FROM s""")
def factorial_cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("item_id"), F.when(F.col("l_suppkey") % 2 == 0, "bare").otherwise("labeled").alias("framing"), (F.col("l_partkey") % 2 == 0).alias("narrow"), F.struct("l_linenumber", (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("pk")).alias("claim_ord"),
        F.struct((F.col("l_partkey") % 9).cast("string").alias("provision_number")).alias("citation"), (F.col("l_orderkey") % 9).cast("string").alias("planted_number"), F.when(F.col("l_suppkey") % 3 == 0, S.CONTRADICTED).otherwise(S.ENTAILED).alias("verdict"),
        F.when(F.col("l_suppkey") % 5 == 0, "no_evidence").otherwise("fuzzy").alias("match_method"),
    )
    return reports.factorial_cells(rows).select("framing", "narrow", "n", "n_detected", "n_detected_matched", F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------- resampling: draws are hashes, so SQL can repeat them


def _drawn(units: str, replicates: int, seed: int) -> str:
    """Weights (replicate, unit, w) of ``bootstrap.replicate_weights`` over a table of one column ``unit``."""
    return f"""u AS (SELECT unit, row_number() OVER (ORDER BY unit NULLS LAST) - 1 AS i, count(*) OVER () AS n FROM {units}),
dr AS (SELECT r.replicate, ('0x' || substr(md5('{seed}:' || r.replicate || ':' || d.d), 1, 8))::BIGINT % nn.n AS i FROM (SELECT unnest(range({replicates})) AS replicate) r CROSS JOIN (SELECT any_value(n) AS n FROM u) nn CROSS JOIN LATERAL (SELECT unnest(range(nn.n)) AS d) d),
wt AS (SELECT dr.replicate, u.unit, count(*) AS w FROM dr JOIN u ON dr.i = u.i GROUP BY ALL)"""


_CLUSTERS = f"{PRED.replace('SELECT l_orderkey,', 'SELECT l_orderkey, (l_suppkey % 25)::VARCHAR AS unit,')}, un AS (SELECT DISTINCT unit FROM p), {_drawn('un', 120, 7)}"
_ACC = "SELECT wt.replicate, sum(w * {0}) / sum(w * n)::DOUBLE AS v FROM (SELECT unit, count(*) AS n, count(*) FILTER (WHERE gold = first) AS a, count(*) FILTER (WHERE gold IS NOT DISTINCT FROM second) AS b FROM p GROUP BY 1) c JOIN wt ON c.unit = wt.unit GROUP BY 1"


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).withColumn("unit", (F.split("id", "-")[3].cast("long") % 25).cast("string"))


@query(f"WITH {_CLUSTERS}, v AS ({_ACC.format('a')}) SELECT 'accuracy' AS metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n FROM v")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over whole clusters resampled."""
    b = bootstrap.cluster_bootstrap(_clustered(spark, d), "unit", "expected_label", "first", 120, 7)
    return b.filter("metric = 'accuracy'").select("metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(f"WITH {_CLUSTERS}, x AS ({_ACC.format('a')}), y AS ({_ACC.format('b')}), v AS (SELECT y.v - x.v AS v FROM x JOIN y ON x.replicate = y.replicate) SELECT (SELECT round(avg((gold IS NOT DISTINCT FROM second)::INTEGER) - avg((gold = first)::INTEGER), 6) FROM p) AS delta, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n FROM v")
def paired_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The second arm's gain, both arms on the same resampled clusters."""
    b = bootstrap.paired_bootstrap(_clustered(spark, d), "unit", "expected_label", "first", "second", replicates=120, seed=7)
    return b.select(*[F.round(c, 6).alias(c) for c in ("delta", "low", "high")], "n")


@query(f"WITH {_CLUSTERS}, x AS ({_ACC.format('a')}), y AS ({_ACC.format('b')}), v AS (SELECT y.v - x.v AS v FROM x JOIN y ON x.replicate = y.replicate), s AS (SELECT list_sort(list(v)) AS s FROM v) SELECT round(s[floor(len(s) * 0.025)::INTEGER + 1], 6) AS low, round(s[least(floor(len(s) * 0.975)::INTEGER, len(s) - 1) + 1], 6) AS high FROM s")
def bootstrap_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The same by index into the sorted draws."""
    b = bootstrap.paired_bootstrap(_clustered(spark, d), "unit", "expected_label", "first", "second", replicates=120, seed=7, by_index=True)
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_ITEMS = f"p AS (SELECT doc_id::VARCHAR AS unit, quality, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS said FROM labels), un AS (SELECT DISTINCT unit FROM p), {_drawn('un', 100, 3)}"


@query(f"WITH {_ITEMS}, v AS (SELECT wt.replicate, sum(w * n * (quality = said)::INTEGER) / sum(w * n)::DOUBLE AS v FROM (SELECT unit, quality, said, count(*) AS n FROM p GROUP BY ALL) c JOIN wt ON c.unit = wt.unit GROUP BY 1) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n FROM v")
def item_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over single items resampled."""
    q = F.col("quality").cast("string")
    rows = table(spark, d, "labels").select("doc_id", q.alias("quality"), F.when(F.col("doc_id") % 5 == 0, (1 - F.col("quality")).cast("string")).otherwise(q).alias("said"))
    b = bootstrap.cluster_bootstrap(rows, "doc_id", "quality", "said", 100, 3, labels=("0", "1"))
    return b.filter("metric = 'accuracy'").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


# ---------------------------------------------------------------- baselines

_FOLDED = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 5 + 1 AS fold, ['Yes','No','Partially'][(l_partkey % 5) // 2 + 1] AS y FROM lineitem)"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    y = F.get(F.array(F.lit("Yes"), F.lit("No"), F.lit("Partially")), F.floor((F.col("l_partkey") % 5) / 2).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 5 + 1).alias("fold"), y.alias("y"))


@query(f"""WITH {_FOLDED}, k AS (SELECT fold, y, count(*) AS n FROM f GROUP BY ALL), o AS (SELECT a.fold, k.y, sum(k.n) AS n FROM (SELECT DISTINCT fold FROM f) a JOIN k ON a.fold <> k.fold GROUP BY ALL),
b AS (SELECT fold, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, list_position(['Yes','No','Partially'], y)) AS r FROM o) WHERE r = 1)
SELECT f.fold, f.y, predicted, count(*) AS n FROM f JOIN b ON f.fold = b.fold GROUP BY ALL""")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    m = bootstrap.majority_baseline(_folded(spark, d), "y", ("Yes", "No", "Partially"))
    return m.groupBy("fold", "y", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FOLDED} SELECT l_partkey, count(DISTINCT fold) AS n FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1")
def fold_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose lines are in several folds."""
    return bootstrap.leaking_groups(_folded(spark, d), "l_partkey")


@query("SELECT 0::BIGINT AS n_leaks, 5::BIGINT AS n_folds, (SELECT count(*) FROM lineitem) AS n_rows")
def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds that keep each supplier's lines together."""
    folded = bootstrap.grouped_folds(_folded(spark, d).drop("fold"), "l_suppkey", "y", 5)
    leaks = bootstrap.leaking_groups(folded, "l_suppkey").agg(F.count(F.lit(1)).alias("n_leaks"))
    return folded.agg(F.count_distinct("fold").alias("n_folds"), F.count(F.lit(1)).alias("n_rows")).join(leaks)


@query(f"WITH {_FOLDED}, k AS (SELECT y, count(*) AS n FROM f GROUP BY 1), t AS (SELECT sum(n) AS a, count(*) AS c FROM k) SELECT y, n, round(a / (c * n)::DOUBLE, 6) AS weight FROM k CROSS JOIN t")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    w = learning.balanced_weights(_folded(spark, d), "y")
    return w.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


# ---------------------------------------------------------------- exact quantiles of one group, batched feature models


@query("SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.999), 6) AS q2 FROM lineitem")
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of one group that is the whole table."""
    q = quantiles.exact_quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", [0.01, 0.5, 0.999])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query(f"""WITH {PRED}, t AS (SELECT range / 200.0::DOUBLE AS threshold FROM range(100, 190)),
s AS (SELECT threshold, gold, greatest(pe, pn, pc) AS c, CASE WHEN pe >= pn AND pe >= pc THEN 'ENTAILED' WHEN pn >= pc THEN 'NOT_ENOUGH_INFORMATION' ELSE 'CONTRADICTED' END AS l FROM p CROSS JOIN t)
SELECT round(threshold, 6) AS threshold, count(*) FILTER (WHERE gold = CASE WHEN c < threshold THEN 'NOT_ENOUGH_INFORMATION' ELSE l END) AS n_right, count(*) AS n FROM s GROUP BY 1""")
def fine_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Ninety thresholds over all predictions."""
    s = verdicts.threshold_sweep(_predictions(spark, d), [k / 200 for k in range(100, 190)])
    right = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    return s.groupBy(F.round("threshold", 6).alias("threshold")).agg(right.alias("n_right"), F.sum("n").alias("n"))


def _shipments(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a label that follows from their way of shipping and the side of 25 of their quantity, folds by supplier."""
    l = table(spark, d, "lineitem")
    label = F.when(F.col("l_partkey") % 3 == 0, "Yes").when(F.col("l_partkey") % 3 == 1, "No").otherwise("Partially")
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("fold"), label.alias("label"), (F.col("l_partkey") % 3).cast("string").alias("mode"),
        F.when(F.col("l_suppkey") % 9 > 0, F.col("l_quantity").cast("double")).alias("quantity"), F.when(F.col("l_linenumber") % 5 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
    )


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber) AS id, (l_suppkey % 4 + 1)::INT AS fold, ['Yes', 'No', 'Partially'][l_partkey % 3 + 1] AS label,
['Yes', 'No', 'Partially'][l_partkey % 3 + 1] AS predicted FROM lineitem""")
def feature_models(spark: SparkSession, d: str) -> DataFrame:
    """Predictions out of fold by models that can tell the label from one of the features."""
    return learning.out_of_fold(_shipments(spark, d), ["mode", "flag"], ["quantity"], "label", "id")


@query("""SELECT left_out, round(accuracy, 6) AS accuracy FROM (VALUES ('all', 1.0::DOUBLE), ('kind', NULL), ('amount', 1.0), ('flag', 1.0)) v(left_out, accuracy)""")
def feature_ablations(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy without each group of features; without the telling one it is near chance, which is not compared."""
    a = learning.ablations(_shipments(spark, d), {"kind": (["mode"], []), "amount": ([], ["quantity"]), "flag": (["flag"], [])}, "label", "id")
    return a.select("left_out", F.when((F.col("left_out") == "kind") & (F.col("accuracy") < 0.5), F.lit(None)).otherwise(F.round("accuracy", 6)).alias("accuracy"))


@query(f"""WITH {_FOLDED}, t AS (SELECT y, count(*) AS n FROM f GROUP BY 1) SELECT y, n AS n_rows, true AS even FROM t""")
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each label's rows in each of the folds are within the largest supplier's of an equal share."""
    rows = _folded(spark, d).drop("fold")
    folded = bootstrap.grouped_folds(rows, "l_suppkey", "y", 5)
    most = rows.groupBy("y", "l_suppkey").count().groupBy("y").agg(F.max("count").alias("most"))
    per = folded.groupBy("y", "fold").count().groupBy("y").agg(F.sum("count").alias("n_rows"), F.max("count").alias("high"), F.min("count").alias("low"))
    return per.join(most, "y").select("y", "n_rows", ((F.col("high") - F.col("low")) <= 2 * F.col("most")).alias("even"))
