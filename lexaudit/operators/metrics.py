"""Classification metrics and paired comparisons, from grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.operators.quantiles import grouped_with_quantiles

FAILED = "INFERENCE_FAILURE"


def confusion(rows: DataFrame, gold: str, predicted: str, *by: str, labels: tuple[str, ...] = S.LABELS, lenient: bool = False) -> DataFrame:
    """(by, gold, predicted, n), dense over the labels for every group. A null prediction is a failure
    of its own, or, if lenient, like every unknown label, not enough information."""
    p = F.coalesce(F.col(predicted), F.lit(FAILED))
    if lenient:
        p = F.when(p.isin(*labels), p).otherwise(F.lit(S.NEI))
    seen = rows.groupBy(*by, F.col(gold).alias("gold"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(q).alias("predicted"), F.lit(0).cast("long").alias("n")) for g in labels for q in labels]))
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    dense = groups.select(*by, pairs.alias("_cell")).select(*by, "_cell.gold", "_cell.predicted", "_cell.n")
    return seen.unionByName(dense).groupBy(*by, "gold", "predicted").agg(F.sum("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def per_class(matrix: DataFrame, *by: str, labels: tuple[str, ...] = S.LABELS) -> DataFrame:
    """(by, label, support, precision, recall, f1) from (gold, predicted, n)."""
    label = F.explode(F.array(*[F.lit(x) for x in labels]))
    cells = matrix.select(*by, "gold", "predicted", "n", label.alias("label"))
    sums = cells.groupBy(*by, "label").agg(
        F.sum(F.when((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)).alias("called"),
    )
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    return sums.select(*by, "label", "support", "tp", "called", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def summary(matrix: DataFrame, *by: str, labels: tuple[str, ...] = S.LABELS) -> DataFrame:
    """n, accuracy (null without rows), macro P/R/F1 over all labels, macro F1 over present ones, weighted F1."""
    classes = per_class(matrix, *by, labels=labels).groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    whole = matrix.groupBy(*by).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("accuracy"))
    named = classes.select(*[F.col(b).alias(f"_{b}") for b in by], *[c for c in classes.columns if c not in by])
    same = F.lit(True)
    for b in by:  # a null group is a group
        same &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    return whole.join(named, same).drop(*[f"_{b}" for b in by])


def strata(rows: DataFrame, condition: str, attributed: str) -> DataFrame:
    """Rows once for each stratum they are in: ALL, by attribution, and by condition."""
    own = F.array(
        F.lit("ALL"),
        F.when(F.col(attributed), F.lit("attributed")).otherwise(F.lit("non_attributed")),
        F.concat(F.lit("condition:"), F.coalesce(condition, F.lit("none"))),
    )
    return rows.withColumn("stratum", F.explode(own))


def best_threshold(points: DataFrame, metric: str = "macro_f1", production: float = 0.7, plateau: float = 0.005) -> DataFrame:
    """The first of the best points, the span within ``plateau`` of it, and the gap to production."""
    top = points.groupBy().agg(F.max(metric).alias("best_value"))
    joined = points.join(top)
    close = F.col(metric) >= F.col("best_value") - plateau
    return joined.groupBy().agg(
        F.min(F.when(F.col(metric) == F.col("best_value"), F.col("threshold"))).alias("best_threshold"),
        F.max("best_value").alias("best_value"),
        F.min(F.when(close, F.col("threshold"))).alias("plateau_from"),
        F.max(F.when(close, F.col("threshold"))).alias("plateau_to"),
        (F.max("best_value") - F.max(F.when(F.abs(F.col("threshold") - production) < 1e-9, F.col(metric)))).alias("gap_to_production"),
    )


def paired(a: DataFrame, b: DataFrame, ident: str = "id", gold: str = "expected_label", predicted: str = "predicted_label") -> DataFrame:
    """Predictions of two arms side by side. Ids that only one arm has fail the query when read."""
    left = a.select(F.col(ident).alias("_a"), F.col(gold).alias("gold"), F.col(predicted).alias("first"))
    right = b.select(F.col(ident).alias("_b"), F.col(predicted).alias("second"))
    both = left.join(right, F.col("_a") == F.col("_b"), "full_outer")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("arms differ in id "), F.coalesce("_a", "_b").cast("string"))).cast("string"))
    return both.select(F.coalesce(ok, F.col("_a").cast("string")).alias(ident), "gold", "first", "second")


def paired_category(gold: Column, first: Column, second: Column) -> Column:
    """What became of an item. Where the arms differ, the second arm's being right is asked before the
    first's, so a change from right to wrong always carries the second arm's name."""
    same = first.eqNullSafe(second)
    abstains = F.coalesce(first.isin(S.NEI, S.NO_EVIDENCE), F.lit(False))
    right_a, right_b = first.eqNullSafe(gold), second.eqNullSafe(gold)
    return (
        F.when(same & abstains, "both_abstain")
        .when(same, "both_agree")
        .when(gold.isNull(), "model_disagreement_ground_truth_unavailable")
        .when(right_b, "v2_improves")
        .when(right_a, "v2_changes_correct_to_incorrect")
        .otherwise("both_fail")
    )


def mcnemar(pairs: DataFrame, *by: str, target: str | None = None) -> DataFrame:
    """Discordant counts and exact p; with ``target``, over items of that gold label."""
    rows = pairs if target is None else pairs.filter(F.col("gold") == target)
    a, b = F.col("gold") == F.coalesce("first", F.lit("")), F.col("gold") == F.coalesce("second", F.lit(""))
    n = rows.groupBy(*by).agg(F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))
    return n.withColumn("p_exact", stats.sign_test(F.col("first_only"), F.col("second_only"))).withColumn("chi2", stats.mcnemar_chi2(F.col("first_only"), F.col("second_only")))


def transitions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of directed changes; unchanged ones together."""
    name = F.when(F.col(before).eqNullSafe(F.col(after)), F.lit("unchanged")).otherwise(F.concat(F.lit("changed_"), F.lower(before), F.lit("_to_"), F.lower(after)))
    return pairs.groupBy(name.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, column: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), *by: str) -> DataFrame:
    """Exact quantiles, linear between ranks, of groups of any size."""
    return grouped_with_quantiles(rows, list(by), column, {f"p{round(100 * p)}": p for p in points}, F.avg(column).alias("mean"), F.count(column).alias("n"))


def confidence_stats(rows: DataFrame, label: str = "verdict", value: str = "confidence") -> DataFrame:
    """n, mean, median, min, max by label and over all (``is_total``)."""
    has = rows.filter(F.col(value).isNotNull())
    plain = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")]
    ends = [F.min(value).alias("min"), F.max(value).alias("max")]
    each = grouped_with_quantiles(has, [label], value, {"median": 0.5}, *plain, *ends).withColumn("is_total", F.lit(False))
    total = grouped_with_quantiles(has, [], value, {"median": 0.5}, *plain, *ends).filter("n > 0").withColumn("is_total", F.lit(True))
    whole = total.withColumn(label, F.lit(None).cast(dict(rows.dtypes)[label]))
    return each.unionByName(whole).select(label, "is_total", "n", "mean", "median", "min", "max")


def histogram(rows: DataFrame, value: str, edges: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Counts in fixed bins, the last one closed; values outside are left out."""
    v = F.col(value)
    bin_ = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (v >= edges[i]) & ((v <= edges[i + 1]) if i == len(edges) - 2 else (v < edges[i + 1]))
        bin_ = F.when(inside, F.lit(i)).otherwise(bin_)
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter("bin is not null")


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    found = grouped_with_quantiles(rows, list(by), value, {"median": 0.5}, F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"))
    return found.select(*by, "mean", "median", "stdev")


def run_summary(cases: DataFrame) -> DataFrame:
    """One row on a run: claims, coverage, corrections, seconds; rounding half to even, null for empty."""
    return cases.groupBy().agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum("n_claims").alias("n_claims"),
        F.bround(F.try_divide(100.0 * F.sum("n_with_evidence"), F.sum("n_claims")), 1).alias("coverage_pct"),
        F.bround(F.avg("n_claims"), 2).alias("claims_per_case"),
        F.count_if(F.col("status") != "not_triggered").alias("n_triggered"),
        F.count_if(F.col("status") == "corrected").alias("n_corrected"),
        F.bround(F.try_divide(100.0 * F.count_if(F.col("status") == "corrected"), F.count_if(F.col("status") != "not_triggered")), 1).alias("corrected_pct"),
        F.bround(F.avg("seconds"), 2).alias("mean_seconds"),
        F.bround(F.percentile("seconds", 0.5), 2).alias("median_seconds"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.sum("seconds").alias("total_seconds"),
    )


def first_failures(rows: DataFrame, ident: str = "id", gold: str = "expected_label", predicted: str = "predicted_label", most: int = 3) -> DataFrame:
    """The first wrong items of each class by id."""
    from pyspark.sql import Window as W

    wrong = rows.filter(~F.col(gold).eqNullSafe(F.col(predicted)))
    return wrong.withColumn("rank", F.row_number().over(W.partitionBy(gold).orderBy(ident))).filter(F.col("rank") <= most)


def stress_arms(rows: DataFrame, arm: str = "framing") -> DataFrame:
    """Detection of planted errors by arm: recall in all and among those with evidence, false alarms on clean twins.

    Recall with evidence counts detected items that have evidence, over items that have it."""
    hit, has = F.col("verdict") == S.CONTRADICTED, F.col("matched")
    planted = ~F.col("clean")
    return rows.groupBy(arm).agg(
        F.count_if(planted).alias("n_planted"),
        F.count_if(planted & hit).alias("n_detected"),
        F.try_divide(F.count_if(planted & hit).cast("double"), F.count_if(planted)).alias("recall"),
        F.count_if(planted & has).alias("n_matched"),
        F.try_divide(F.count_if(planted & has & hit).cast("double"), F.count_if(planted & has)).alias("recall_matched"),
        F.try_divide(F.count_if(~planted & hit).cast("double"), F.count_if(~planted)).alias("false_positive_rate"),
        F.count_if((F.col("status") == "corrected") & (F.col("reverified") != S.ENTAILED)).alias("n_unsafe_shipped"),
    )
