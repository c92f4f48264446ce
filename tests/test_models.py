"""Exact quantiles, sweeps, numbering and resampling of any size, and models fitted together, against plain computations."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.operators import bootstrap, learning, metrics, quantiles, verdicts


def test_quantiles_equal_percentile_in_every_bit(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else r.choice([r.random() * 1e6, 0.1, 0.2, -0.0, 3.0]), r.randint(1, 4)) for _ in range(3000)] + [("z", None, 1), ("one", 0.3, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    levels = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    want = {x["g"]: tuple(x)[1:] for x in df.groupBy("g").agg(*(F.percentile("x", q).alias(f"q{i}") for i, q in enumerate(levels))).collect()}
    assert {x["g"]: tuple(x)[1:] for x in quantiles.exact_quantiles(df, ["g"], "x", levels).collect()} == want
    whole = df.agg(*(F.percentile("x", q) for q in levels)).first()
    assert tuple(quantiles.exact_quantiles(df, [], "x", levels).first()) == tuple(whole)
    weighted = tuple(quantiles.exact_quantiles(df, [], "x", levels, weight="n").first())
    assert weighted == tuple(df.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).agg(*(F.percentile("x", q) for q in levels)).first())
    empty = quantiles.exact_quantiles(df.limit(0), ["g"], "x", [0.5])
    assert empty.collect() == [] and quantiles.exact_quantiles(df.limit(0), [], "x", [0.5]).first()[0] is None
    with pytest.raises(ValueError, match="levels"):
        quantiles.exact_quantiles(df, [], "x", [1.5])
    stats = {(x["verdict"], x["is_total"]): x for x in metrics.confidence_stats(df.selectExpr("g as verdict", "x as confidence")).collect()}
    assert stats[(None, True)]["median"] == whole[3] and stats[("a", False)]["median"] == want["a"][3] and (None, False) in stats


def test_sweep_against_every_threshold(spark):
    r = random.Random(5)
    keys = [k for k, _ in verdicts.S.SCORE_LABELS]
    rows = [(r.choice(["x", "y"]), r.choice([None, {}, {k: round(r.random(), 1) for k in r.sample(keys, r.randint(1, 3))}])) for _ in range(400)]
    df = spark.createDataFrame(rows, "expected_label string, raw_scores map<string,double>")
    points = [0.9, 0.1, 0.5, 0.55]
    got = sorted(map(repr, (tuple(x) for x in verdicts.threshold_sweep(df, points).collect())))
    want = []
    for t in points:
        some = df.withColumn("v", verdicts.verdict(F.col("raw_scores"), F.lit(t))).groupBy(F.lit(t).alias("t"), "expected_label", F.col("v.label").alias("p"))
        want += some.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v.sub_reason").isNotNull()).alias("low")).collect()
    assert got == sorted(map(repr, (tuple(x) for x in want)))


def test_numbering_and_draws(spark):
    names = [f"u{k:03d}" for k in range(150)] + [None]
    df = spark.createDataFrame([(x,) for x in names * 2], "unit string").repartition(7)
    units, n = bootstrap.numbered_units(df, "unit")
    assert n == 151 and [r["unit"] for r in units.orderBy("u").collect()] == names and [r["u"] for r in units.orderBy("u").collect()] == list(range(151))
    sent = sorted(map(repr, bootstrap.replicate_weights(units, n, 100, 4).collect()))
    was, bootstrap.BROADCAST_UNITS = bootstrap.BROADCAST_UNITS, 10
    try:
        assert sorted(map(repr, bootstrap.replicate_weights(units, n, 100, 4).collect())) == sent  # joined by a shuffle
    finally:
        bootstrap.BROADCAST_UNITS = was
    total = bootstrap.replicate_weights(units, n, 100, 4).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert Counter(r["n"] for r in total) == {151: 100}


def test_bootstrap_has_no_cap(spark):
    df = spark.range(120_000).selectExpr("cast(id as string) as unit", "'Yes' as y", "if(id % 4 = 0, 'No', 'Yes') as p")
    units, n = bootstrap.numbered_units(df, "unit")
    assert n == 120_000 and units.agg(F.count_distinct("u"), F.max("u")).first()[:] == (120_000, 119_999)


def plain_newton(x, y, w, classes, penalty):
    """Coefficients of one model, by Newton's method on all rows at once."""
    j, p = (1 if classes == 2 else classes), x.shape[1]
    beta, free = np.zeros((j, p)), np.tile(np.arange(p) < p - 1, j)
    for _ in range(60):
        s = x @ beta.T
        s = np.hstack([np.zeros((len(x), 1)), s]) if classes == 2 else s
        e = np.exp(s - s.max(1, keepdims=True))
        share = e / e.sum(1, keepdims=True)
        off = (share - np.eye(classes)[y])[:, -j:]
        g = penalty * ((off * w[:, None]).T @ x).ravel() + np.where(free, beta.ravel(), 0)
        h = np.zeros((j * p, j * p))
        for a in range(j):
            for b in range(j):
                q = share[:, classes - j + a] * ((a == b) - share[:, classes - j + b])
                h[a * p : (a + 1) * p, b * p : (b + 1) * p] = (x * (w * q)[:, None]).T @ x
        step = np.linalg.pinv(penalty * h + np.diag(free.astype(float))) @ g
        beta = beta - step.reshape(j, p)
    return beta


@pytest.mark.parametrize("labels", [["a", "b"], ["a", "b", "c"]])
def test_models_equal_a_plain_solution(spark, labels):
    r = random.Random(len(labels))
    rows = []
    for i in range(240):
        y, cat = r.choice(labels), r.choice(["u", "v", None])
        x = r.gauss(labels.index(y), 1.5)
        rows.append((i, i % 3 + 1, y, cat, None if r.random() < 0.15 else x, r.gauss(0, 3)))
    df = spark.createDataFrame(rows, "id long, fold int, label string, cat string, x double, z double").repartition(5)
    told, models, features = learning.predictions(df, {"kind": (["cat"], []), "numbers": ([], ["x", "z"])}, "label", "id")
    assert len(models) == 9 and features.names == ["x", "z", "cat", "cat", "cat"]
    guesses = {(p["id"], p["left_out"]): p["predicted"] for p in told.collect()}
    for m in models:
        train = [q for q in rows if q[1] != m.fold]
        numbers = np.array([[np.nan if q[4] is None else q[4], q[5]] for q in train])
        median = np.nanmedian(numbers, axis=0)
        filled = np.where(np.isnan(numbers), median, numbers)
        mean, sd = filled.mean(0), filled.std(0)
        design = lambda some, median=median, mean=mean, sd=sd, m=m: np.hstack([np.hstack([(np.where(np.isnan(n := np.array([[np.nan if q[4] is None else q[4], q[5]] for q in some])), median, n) - mean) / sd, np.array([[(q[3] or learning.MISSING) == c for c in ("MISSING", "u", "v")] for q in some], float)])[:, m.use], np.ones((len(some), 1))])
        y = np.array([labels.index(q[2]) for q in train])
        w = (len(y) / (len(labels) * np.bincount(y)))[y]
        beta = plain_newton(design(train), y, w, len(labels), learning.PENALTY)
        x = design([q for q in rows if q[1] == m.fold])
        mine, plain = x @ m.beta.T, x @ beta.T
        if len(labels) > 2:
            mine, plain = mine - mine.mean(1, keepdims=True), plain - plain.mean(1, keepdims=True)
        assert np.abs(m.beta[:, :-1] - beta[:, :-1]).max() < 1e-6 and np.abs(mine - plain).max() < 1e-6
        best = plain.argmax(1) if len(labels) > 2 else (plain[:, 0] > 0).astype(int)
        assert [guesses[q[0], m.left_out] for q in rows if q[1] == m.fold] == [labels[b] for b in best]


def test_models_of_odd_tables(spark):
    rows = [(1, 1, "a", None, None), (2, 1, None, "x", 1.0), (3, 2, "b", "y", None), (4, 2, "a", "x", 2.0), (5, 3, "b", None, 5.0), (5, 3, "b", None, 5.0)]
    df = spark.createDataFrame(rows, "id long, fold int, label string, cat string, x double")
    got = learning.out_of_fold(df, ["cat"], ["x"], "label", "id").collect()
    assert len(got) == 6 and {g["predicted"] for g in got} <= {"a", "b"}
    with pytest.raises(ValueError, match="two folds"):
        learning.out_of_fold(df.filter("fold = 1"), ["cat"], ["x"], "label", "id")
