"""Bootstrap intervals from replicate weights, folds and the majority baseline.

Draws over units (items or clusters) are made by tasks, from a hash of seed, replicate and draw, and joined
as weights, so replicates meet pre-aggregated counts, not rows. Units are numbered by ranges, in as many
tasks as there are partitions, and draws are dealt out by number: any number of units goes one way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.operators import metrics
from lexaudit.session import cut

#: Units up to which they are sent to all tasks; more are joined by a shuffle.
BROADCAST_UNITS = 100_000
_DRAWS = 500_000
#: Groups that a task deals to the folds one by one.
_DEALT = 20_000
ROUNDS = 20


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``u``, the place of each row in an order without ties, from 0: sorted by ranges, which are counted."""
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(shares, *order).sortWithinPartitions(*order))
    found = {r["p"]: r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before, starts = 0, []
    for p in range(max(found, default=0) + 1):
        starts.append(before)
        before += found.get(p, 0)
    at = placed.withColumn("_at", F.monotonically_increasing_id())  # the partition's number, then the row's, in 33 bits
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.shiftright("_at", 33).cast("int"))
    return at.withColumn("u", start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def numbered_units(rows: DataFrame, unit: str) -> tuple[DataFrame, int]:
    """(unit, u): distinct units as strings, numbered in their order from 0, null last; and how many there are."""
    units = numbered(rows.select(F.col(unit).cast("string").alias("unit")).distinct(), F.col("unit").asc_nulls_last())
    return units, units.count()


def replicate_weights(units: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, unit, weight): times each of the ``n`` numbered units is drawn in each resample of as many."""
    if replicates < 100:
        raise ValueError("at least 100 replicates")
    if n < 2:
        raise ValueError("at least two units")
    every = units.sparkSession.range(replicates * n, numPartitions=max(1, min(replicates * n // _DRAWS, 100_000)))
    draws = every.select(F.expr(f"int(id div {n}L)").alias("replicate"), (F.col("id") % F.lit(n)).alias("draw"))
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "draw")), 1, 8), 16, 10).cast("long"), F.lit(n))
    weights = draws.groupBy("replicate", drawn.alias("d")).agg(F.count(F.lit(1)).alias("weight"))
    named = F.broadcast(units) if n <= BROADCAST_UNITS else units
    return weights.join(named, F.col("d") == F.col("u")).select("replicate", "unit", "weight")


def interval(values: DataFrame, column: str, level: float = 0.95, by_index: bool = False, *by: str) -> DataFrame:
    """(low, high) over replicates: linear between ranks, or by index into the sorted values; nulls are skipped."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    a = (1 - level) / 2
    if not by_index:
        return values.groupBy(*by).agg(F.percentile(column, a).alias("low"), F.percentile(column, 1 - a).alias("high"), F.count(column).alias("n"))
    ranked = values.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("_v"))
    n = F.size("_v")
    at = lambda q: F.get(F.col("_v"), F.least((F.floor(n * q)).cast("int"), n - 1))
    return ranked.select(*by, at(a).alias("low"), at(1 - a).alias("high"), n.cast("long").alias("n"))


def cluster_counts(rows: DataFrame, unit: str, gold: str, predicted: str, *by: str) -> DataFrame:
    return rows.groupBy(F.col(unit).cast("string").alias("unit"), F.col(gold).alias("gold"), F.coalesce(predicted, F.lit(metrics.FAILED)).alias("predicted"), *by).agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(counts: DataFrame, weights: DataFrame, *by: str, labels: tuple[str, ...] = S.LABELS) -> DataFrame:
    """Metrics of every replicate, from cluster counts and weights."""
    drawn = weights.withColumnRenamed("unit", "_unit")
    matrix = counts.join(drawn, F.col("unit").eqNullSafe(F.col("_unit"))).groupBy("replicate", *by, "gold", "predicted").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    return metrics.summary(matrix, "replicate", *by, labels=labels)


def cluster_bootstrap(rows: DataFrame, unit: str, gold: str, predicted: str, replicates: int = 2000, seed: int = 1, level: float = 0.95, labels: tuple[str, ...] = S.LABELS) -> DataFrame:
    """Intervals of accuracy and macro F1, whole clusters resampled: (metric, low, high, n)."""
    weights = replicate_weights(*numbered_units(rows, unit), replicates, seed)
    values = weighted_metrics(cluster_counts(rows, unit, gold, predicted), weights, labels=labels)
    parts = [interval(values, m, level).select(F.lit(m).alias("metric"), "low", "high", "n") for m in ("accuracy", "macro_f1")]
    return parts[0].unionByName(parts[1])


def paired_bootstrap(rows: DataFrame, unit: str, gold: str, first: str, second: str, metric: str = "accuracy", replicates: int = 2000, seed: int = 1, level: float = 0.95, by_index: bool = False, labels: tuple[str, ...] = S.LABELS) -> DataFrame:
    """Interval of the second arm's gain, both arms on the same resamples: (delta, low, high, n)."""
    weights = replicate_weights(*numbered_units(rows, unit), replicates, seed)
    arms = [weighted_metrics(cluster_counts(rows, unit, gold, p), weights, labels=labels).select("replicate", F.col(metric).alias(a)) for a, p in (("x", first), ("y", second))]
    deltas = arms[0].join(arms[1], "replicate").withColumn("delta", F.col("y") - F.col("x"))
    whole = [metrics.summary(metrics.confusion(rows, gold, p, labels=labels), labels=labels).select(F.col(metric).alias(a)) for a, p in (("x", first), ("y", second))]
    observed = whole[0].join(whole[1]).select((F.col("y") - F.col("x")).alias("delta"))
    return observed.join(interval(deltas, "delta", level, by_index))


def _told_apart(v: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Counts by label as shares of the whole: rows, then what each label has more or less than the rows let expect.

    Groups are mostly alike in their labels, so that counts as they are would hide what they differ in. Rows weigh
    tenfold, or else a fold with one row of a rare label would draw all that it takes to dilute it."""
    size = v.sum(axis=1, keepdims=True)
    return np.hstack([10 * size / max(whole.sum(), 1), (v - size * whole / max(whole.sum(), 1)) / np.maximum(whole, 1)])


def _deal(v: np.ndarray, k: int) -> np.ndarray:
    """The fold, from 0, of each group in turn: the one that has least of what the group brings, so that no drift adds up."""
    each = _told_apart(v, v.sum(axis=0))
    totals, folds = np.zeros((k, each.shape[1])), np.empty(len(each), int)
    for i, x in enumerate(each):
        folds[i] = a = (totals @ x).argmin()
        totals[a] += x
    return folds


def _turn(totals: np.ndarray, part: np.ndarray) -> list[int]:
    """The fold that each fold of a part is put to: exchanged by twos until none lessens the spread of both together.

    Deviations then never point the same way on the whole, so the squared spread grows by the part's own at most."""
    meet = (totals - totals.mean(axis=0)) @ (part - part.mean(axis=0)).T
    to, again = list(range(len(part))), True
    while again:
        again = False
        for a in range(len(to)):
            for b in range(a):
                if meet[to[a], b] + meet[to[b], a] < meet[to[a], a] + meet[to[b], b] - 1e-15:
                    to[a], to[b], again = to[b], to[a], True
    return to


def _moves(groups: DataFrame, totals: np.ndarray) -> list[tuple]:
    """For each pair of folds the group whose move between them lessens the spread most: (gain, group, from, to, counts)."""
    k, width = totals.shape
    scale = np.maximum(totals.sum(axis=0), 1) ** 2
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in totals])
    a, b = F.get(table, F.col("fold") - 1), F.get(table, F.col("to") - 1)
    v = [F.get(F.col("v"), F.lit(i)) for i in range(width)]
    gain = sum((2 * v[i] * (F.get(a, F.lit(i)) - F.get(b, F.lit(i)) - v[i]) / float(scale[i]) for i in range(width)), F.lit(0.0))
    tried = groups.withColumn("to", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter("to <> fold").withColumn("gain", gain).filter("gain > 0")
    best = tried.groupBy("fold", "to").agg(F.max(F.struct("gain", F.col("u").alias("u"), "v")).alias("m"))
    return [(r["m"]["gain"], r["m"]["u"], r["fold"], r["to"], np.asarray(r["m"]["v"], float)) for r in best.collect()]


def _swaps(groups: DataFrame, totals: np.ndarray) -> list[tuple]:
    """For each two folds the groups whose counts lie furthest along the folds' difference, one of each: (u, its fold, counts, u, its fold, counts).

    Where groups are large a move upsets the folds' sizes; two groups in exchange even out labels alone."""
    k, width = totals.shape
    scale = np.maximum(totals.sum(axis=0), 1) ** 2
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in totals])
    own, other = F.get(table, F.col("fold") - 1), F.get(table, F.col("to") - 1)
    along = sum((F.get("v", F.lit(i)) * (F.get(own, F.lit(i)) - F.get(other, F.lit(i))) / float(scale[i]) for i in range(width)), F.lit(0.0))
    tried = groups.withColumn("to", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter("to <> fold").withColumn("along", along)
    best = {(r["fold"], r["to"]): (r["m"]["u"], np.asarray(r["m"]["v"], float)) for r in tried.groupBy("fold", "to").agg(F.max(F.struct("along", F.col("u").alias("u"), "v")).alias("m")).collect()}
    return [(*best[a, b], a, *best[b, a], b) for a, b in sorted(best) if a < b and (b, a) in best]


def grouped_folds(rows: DataFrame, group: str, label: str, n_splits: int = 5, seed: int = 1) -> DataFrame:
    """Adds ``fold``: groups stay whole, folds get like numbers of rows and labels; null groups and labels are values.

    Groups are sorted by their rows, ties in a seeded order, and dealt in turn to parts of ``_DEALT`` groups or so, all of
    like make. A task deals a part's groups, the largest first, each to the fold that has least of its labels and rows;
    the parts' folds are then matched so that what one has too much of another lacks. So folds differ by little more
    than a group, whatever their number. Then rounds move groups: tasks propose for each pair of folds the move that lessens
    the squared spread of label shares most, and a round takes those that still do after the ones before, or
    exchanges groups of two folds where no move does, until there is none or ``ROUNDS`` are over. The driver holds a row a pair of folds,
    one a fold of a part, and the moves made. Labels are few; their counts are a group's columns. The folds are planned by jobs that run at once."""
    named = rows.select(F.col(group).cast("string").alias("g"), F.col(label).cast("string").alias("y"))
    labels = [r["y"] for r in named.select("y").distinct().orderBy(F.col("y").asc_nulls_last()).collect()]
    counts = named.groupBy("g").agg(*(F.count_if(F.col("y").eqNullSafe(F.lit(y))).cast("double").alias(f"n{i}") for i, y in enumerate(labels)))
    v = F.array(*[F.col(f"n{i}") for i in range(len(labels))]) if labels else F.array().cast("array<double>")
    sized = counts.select("g", v.alias("v"))
    order = [F.aggregate("v", F.lit(0.0), lambda x, y: x + y).desc(), F.xxhash64(F.lit(seed), "g"), F.col("g").asc_nulls_last()]
    placed = numbered(sized, *order)
    n = placed.count()
    if not 2 <= n_splits <= n:
        raise ValueError(f"splits must be between 2 and the number of groups ({n})")
    parts = max(1, n // max(_DEALT, 2 * n_splits))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("u")
        return part.assign(fold=_deal(np.vstack(part["v"].to_list()), n_splits) + 1)

    own = cut(placed.withColumn("part", F.col("u") % parts).groupBy("part").applyInPandas(deal, "g string, v array<double>, u long, part long, fold int"))
    of_parts = np.zeros((parts, n_splits, len(labels)))
    for r in own.groupBy("part", "fold").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"n{i}") for i in range(len(labels)))).collect():
        of_parts[r["part"], r["fold"] - 1] = [r[f"n{i}"] for i in range(len(labels))]
    totals, to = np.zeros((n_splits, len(labels))), []
    whole = of_parts.sum(axis=(0, 1))
    for part in of_parts:
        to.append(_turn(_told_apart(totals, whole), _told_apart(part, whole)))
        totals[to[-1]] += part
    turned = rows.sparkSession.createDataFrame([(p, f + 1, x + 1) for p, folds in enumerate(to) for f, x in enumerate(folds)], "part long, fold int, _to int")
    dealt = cut(own.join(F.broadcast(turned), ["part", "fold"]).select("g", "v", "u", F.col("_to").alias("fold")))
    moved: dict[int, int] = {}

    def now() -> DataFrame:
        if not moved:
            return dealt
        small = rows.sparkSession.createDataFrame(list(moved.items()), "_u long, _to int")
        return dealt.join(F.broadcast(small), F.col("u") == F.col("_u"), "left").withColumn("fold", F.coalesce("_to", "fold")).drop("_u", "_to")

    scale = np.maximum(totals.sum(axis=0), 1) ** 2
    for _ in range(ROUNDS):
        taken: set[int] = set()
        for _gain, u, a, b, counts_ in sorted(_moves(now(), totals), key=lambda m: (-m[0], m[1], m[3])):
            still = (2 * counts_ * (totals[a - 1] - totals[b - 1] - counts_) / scale).sum()
            if still > 1e-12 and u not in taken:
                totals[a - 1] -= counts_
                totals[b - 1] += counts_
                moved[u] = b
                taken.add(u)
        if not taken:
            for u, mine, a, w, theirs, b in _swaps(now(), totals):
                x = mine - theirs
                if (2 * x * (totals[a - 1] - totals[b - 1] - x) / scale).sum() > 1e-12 and not taken & {u, w}:
                    totals[a - 1] -= x
                    totals[b - 1] += x
                    moved.update({u: b, w: a})
                    taken |= {u, w}
        if not taken:
            break
    fold = now().select(F.col("g").alias("_g"), F.col("fold").alias("fold"))
    return rows.join(fold, F.col(group).cast("string").eqNullSafe(F.col("_g"))).drop("_g")


def leaking_groups(folded: DataFrame, group: str) -> DataFrame:
    """(group, n): groups that are in several folds."""
    return folded.groupBy(group).agg(F.count_distinct("fold").alias("n")).filter("n > 1")


def check_no_leak(folded: DataFrame, group: str) -> None:
    bad = leaking_groups(folded, group).limit(1).collect()
    if bad:
        raise ValueError(f"group in several folds: {bad[0][0]}")


def majority_baseline(folded: DataFrame, label: str, labels: tuple[str, ...], first_seen: Column | None = None) -> DataFrame:
    """Adds ``predicted``: the label most frequent outside the row's fold. Ties go to the first in
    ``labels`` or, if ``first_seen`` (an ordinal) is given, to the label seen first."""
    per = folded.groupBy("fold", F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n"), *([F.min(first_seen).alias("seen")] if first_seen is not None else []))
    folds = folded.select(F.col("fold").alias("_f")).distinct()
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_y")) if first_seen is None else F.min("seen")
    outside = folds.join(per, F.col("_f") != F.col("fold"))  # folds by labels: a handful of rows
    sums = outside.groupBy("_f", "_y").agg(F.sum("n").alias("n"), *([place.alias("place")] if first_seen is not None else []))
    sums = sums if first_seen is not None else sums.withColumn("place", place)
    best = sums.withColumn("_r", F.row_number().over(W.partitionBy("_f").orderBy(F.col("n").desc(), "place"))).filter("_r = 1").select("_f", F.col("_y").alias("predicted"))
    return folded.join(best, F.col("fold") == F.col("_f")).drop("_f")
