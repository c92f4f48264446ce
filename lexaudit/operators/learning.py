"""Feature models out of fold: imputed, scaled, one-hot features and a balanced logistic regression with a penalty.

All models, one for each fold and each group of features left out, are fitted together by Newton's method: an
iteration is one job, in which tasks add up gradients and Hessians of all models over their rows, and the
driver solves a small system a model. Rows of a fold that are equal in label and features are one row with
their number. The driver holds categories, a few numbers a fold, and the models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.quantiles import exact_quantiles
from lexaudit.session import cut

MISSING = "MISSING"
PENALTY = 0.5
STEPS, TOLERANCE = 50, 1e-9
_MERGE = 16


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over classes times the class' rows."""
    n = df.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(n.join(total), F.col(label) == F.col("_y")).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_y", "_n", "_all", "_k")


@dataclass
class Model:
    """One fold's model with some features: what it takes of a row, and its coefficients (the last is the constant)."""

    fold: int
    left_out: str
    use: np.ndarray  # of features
    classes: np.ndarray  # numbers of those in its training rows
    weight: np.ndarray  # of classes
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # a row for each class, one row where there are two

    def design(self, numbers: np.ndarray, hot: np.ndarray) -> np.ndarray:
        scaled = (np.where(np.isnan(numbers), self.median, numbers) - self.mean) / self.scale
        return np.hstack([np.hstack([scaled, hot])[:, self.use], np.ones((len(numbers), 1))])

    def shares(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.beta.T
        if len(self.classes) == 2:
            score = np.hstack([np.zeros((len(x), 1)), score])
        score -= score.max(axis=1, keepdims=True)
        e = np.exp(score)
        return e / e.sum(axis=1, keepdims=True)


class Features:
    """Feature columns as numbers: numeric ones, then an indicator of each category; null is a category."""

    def __init__(self, numeric: list[str], categories: dict[str, list[str]], classes: list[str]):
        self.numeric, self.categories, self.classes = numeric, categories, classes
        self.names = [*numeric, *(c for c, values in categories.items() for _ in values)]

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        numbers = [np.asarray(batch.column(f"n{i}").to_pandas(), float) for i in range(len(self.numeric))]
        hot = []
        for i, values in enumerate(self.categories.values()):
            own = np.asarray(batch.column(f"c{i}").to_pylist(), object)
            hot += [(own == v).astype(float) for v in values]
        rows = batch.num_rows
        return (np.stack(numbers, 1) if numbers else np.zeros((rows, 0))), (np.stack(hot, 1) if hot else np.zeros((rows, 0)))


def _columns(folded: DataFrame, categorical: list[str], numeric: list[str], label: str, ident: list[str]) -> DataFrame:
    cats = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"c{i}") for i, c in enumerate(categorical)]
    nums = [F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)]
    return folded.select(*(F.col(c).alias(f"i{i}") for i, c in enumerate(ident)), F.col("fold").cast("int").alias("fold"), F.col(label).cast("string").alias("y"), *nums, *cats)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows that are equal in fold, label and features as one, with their number (``times``)."""
    own = [c for c in rows.columns if not c.startswith("i")]
    return cut(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("times")))


def _prepared(data: DataFrame, features: Features, groups: dict[str, tuple[list[str], list[str]]]) -> list[Model]:
    """Models without coefficients: class weights, medians, means and deviations of each fold's training rows. ``data`` is counted."""
    count = {(r["fold"], r["y"]): r["n"] for r in data.groupBy("fold", "y").agg(F.sum("times").alias("n")).collect()}
    folds, wide = sorted({f for f, _ in count}), len(features.numeric)
    if len(folds) < 2:
        raise ValueError("at least two folds")
    medians, means, spread = ({f: np.zeros(wide) for f in folds} for _ in range(3))
    if wide:
        long = data.select("fold", "times", F.posexplode(F.array(*[F.col(f"n{i}") for i in range(wide)])).alias("at", "x"))
        each = long.groupBy("fold", "at", "x").agg(F.sum("times").alias("n")).withColumn("train", F.explode(F.array(*[F.lit(f) for f in folds]))).filter("train <> fold")
        for r in exact_quantiles(each, ["train", "at"], "x", [0.5], weight="n").collect():
            medians[r["train"]][r["at"]] = 0.0 if r["q0"] is None else r["q0"]
        known = F.when(F.col("x").isNotNull(), F.col("times"))
        sums = long.groupBy("fold", "at").agg(F.sum("times").alias("n"), F.coalesce(F.sum(known), F.lit(0)).alias("k"), F.try_divide(F.sum(known * F.col("x")), F.sum(known)).alias("m")).collect()
        centre = F.broadcast(data.sparkSession.createDataFrame([(r["fold"], r["at"], r["m"]) for r in sums], "f int, a int, m double"))
        away = long.join(centre, (F.col("fold") == F.col("f")) & (F.col("at") == F.col("a"))).groupBy("fold", "at")
        spreads = {(r["fold"], r["at"]): r["v"] for r in away.agg(F.try_divide(F.sum(known * (F.col("x") - F.col("m")) ** 2), F.sum(known)).alias("v")).collect()}
        moments = [(r["fold"], r["at"], r["n"], r["k"], r["m"], spreads[r["fold"], r["at"]]) for r in sums]
        for f in folds:
            for i in range(wide):
                parts = [(k, m, v) for g, at, _, k, m, v in moments if g != f and at == i and k]
                holes = sum(n - k for g, at, n, k, _, _ in moments if g != f and at == i)
                parts += [(holes, medians[f][i], 0.0)] if holes else []
                total = sum(p[0] for p in parts)
                means[f][i] = sum(k * m for k, m, _ in parts) / total
                spread[f][i] = np.sqrt(sum(k * (v + (m - means[f][i]) ** 2) for k, m, v in parts) / total)
    models = []
    for f in folds:
        train = np.array([sum(n for (g, y), n in count.items() if g != f and y == c) for c in features.classes], float)
        present = np.flatnonzero(train)
        weight = np.zeros(len(train))
        weight[present] = train.sum() / (len(present) * train[present])
        for name in ("all", *groups):
            gone = {c for part in groups.get(name, ([], [])) for c in part}
            use = np.array([c not in gone for c in features.names], bool)
            beta = np.zeros((1 if len(present) == 2 else len(present), int(use.sum()) + 1))
            models.append(Model(f, name, use, present, weight, medians[f], means[f], np.where(spread[f] > 0, spread[f], 1.0), beta))
    return models


def _sums(model: Model, fold: np.ndarray, y: np.ndarray, times: np.ndarray, numbers: np.ndarray, hot: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of one model over some rows, each as often as its number says."""
    j, p = model.beta.shape
    mine = (fold != model.fold) & np.isin(y, model.classes)
    x, own = model.design(numbers[mine], hot[mine]), np.searchsorted(model.classes, y[mine])
    w, share = model.weight[y[mine]] * times[mine], model.shares(x)
    loss = -float((w * np.log(np.maximum(share[np.arange(len(own)), own], 1e-300))).sum())
    off = share - (np.arange(share.shape[1]) == own[:, None])
    share, off = share[:, -j:], off[:, -j:]
    gradient = (off * w[:, None]).T @ x
    hessian = np.zeros((j, p, j, p))
    for a in range(j):
        for b in range(a, j):
            r = w * share[:, a] * ((a == b) - share[:, b])
            hessian[a, :, b] = x.T @ (x * r[:, None])
            hessian[b, :, a] = hessian[a, :, b].T
    return loss, gradient, hessian.reshape(j * p, j * p)


def fit(data: DataFrame, features: Features, models: list[Model], penalty: float = PENALTY) -> int:
    """Coefficients of all models at once, of counted ``data``; the number of steps. Each minimises ``penalty`` x weighted loss + half the squared coefficients without constants."""
    place = {c: i for i, c in enumerate(features.classes)}

    def job(at: list[np.ndarray]) -> dict[int, tuple]:
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for m, beta in zip(models, at, strict=True):
                m.beta = beta
            for batch in batches:
                fold, y = np.asarray(batch.column("fold").to_pylist()), np.array([place.get(c, -1) for c in batch.column("y").to_pylist()])
                times, (numbers, hot) = np.asarray(batch.column("times"), float), features.read(batch)
                for i, m in enumerate(models):
                    got = _sums(m, fold, y, times, numbers, hot)
                    total[i] = list(got) if i not in total else [a + b for a, b in zip(total[i], got, strict=True)]
            for i, (loss, gradient, hessian) in total.items():
                yield pa.RecordBatch.from_pydict({"model": pa.array([i], pa.int32()), "loss": [loss], "g": [gradient.tobytes()], "h": [hessian.tobytes()]})

        def merge(some: pd.DataFrame) -> pd.DataFrame:
            add = lambda c: sum(np.frombuffer(b) for b in some[c]).tobytes()
            return pd.DataFrame({"model": [some["model"].iloc[0]], "loss": [some["loss"].sum()], "g": [add("g")], "h": [add("h")]})

        kind = "model int, loss double, g binary, h binary"
        some = data.mapInArrow(parts, kind).withColumn("share", F.spark_partition_id() % _MERGE)
        halves = some.groupBy("model", "share").applyInPandas(lambda f: merge(f), kind)
        return {r["model"]: (r["loss"], np.frombuffer(r["g"]), np.frombuffer(r["h"])) for r in halves.groupBy("model").applyInPandas(merge, kind).collect()}

    at = [m.beta for m in models]
    step: list[np.ndarray | None] = [None] * len(models)
    best = [np.inf] * len(models)
    for n in range(1, STEPS + 1):
        sums, most = job(at), 0.0
        for i, m in enumerate(models):
            j, p = at[i].shape
            free = np.tile(np.arange(p) < p - 1, j)
            loss, g, h = sums[i]
            value = penalty * loss + 0.5 * float((at[i].ravel()[free] ** 2).sum())
            if step[i] is not None and value > best[i] + 1e-12 * abs(best[i]):  # too far: half the way back
                step[i] = step[i] / 2
                at[i] = at[i] + step[i]
                most = max(most, float(np.abs(step[i]).max()))
                continue
            best[i] = value
            g, h = penalty * g + np.where(free, at[i].ravel(), 0.0), penalty * h.reshape(j * p, j * p) + np.diag(free.astype(float))
            step[i] = np.linalg.lstsq(h, g, rcond=1e-12)[0].reshape(j, p)  # constants of all classes have one direction too many
            at[i] = at[i] - step[i]
            most = max(most, float(np.abs(step[i]).max()))
        if most < TOLERANCE:
            break
    for m, beta in zip(models, at, strict=True):
        m.beta = beta
    return n


def predictions(folded: DataFrame, groups: dict[str, tuple[list[str], list[str]]], label: str, *ident: str, categorical: list[str] | None = None, numeric: list[str] | None = None, penalty: float = PENALTY) -> tuple[DataFrame, list[Model], Features]:
    """(ident…, fold, label, left_out, predicted) for every row and every group of features left out, ``all`` for none; the models, and their features.
    Without ``ident``, equal rows are one, and ``times`` is their number.

    ``groups`` has names of categorical and numeric columns by group. Rows of a class that is not among the
    training rows are judged by the classes that are; null labels are of no class and are only judged.
    Ties go to the first class in order. Medians are exact; jobs run while the models are planned."""
    categorical = list(dict.fromkeys(c for g in groups.values() for c in g[0])) if categorical is None else categorical
    numeric = list(dict.fromkeys(c for g in groups.values() for c in g[1])) if numeric is None else numeric
    rows = _columns(folded, categorical, numeric, label, list(ident))
    rows = cut(rows) if ident else rows
    data = _counted(rows)
    classes = [r["y"] for r in data.select("y").distinct().filter("y is not null").orderBy("y").collect()]
    known: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        pairs = data.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(categorical))])).alias("s")).select("s.*").distinct()
        for r in sorted(pairs.collect(), key=lambda r: (r["c"], r["v"])):
            known[categorical[r["c"]]].append(r["v"])
    features = Features(numeric, known, classes)
    models = _prepared(data, features, groups)
    fit(data, features, models, penalty)
    kinds = dict(folded.dtypes)
    kept = [*(f"i{i}" for i in range(len(ident))), *([] if ident else ["times"]), "fold", "y"]
    schema = ", ".join([*(f"i{i} {kinds[c]}" for i, c in enumerate(ident)), *([] if ident else ["times long"]), "fold int, y string, left_out string, predicted string"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.asarray(classes, object)
        for batch in batches:
            fold, (numbers, hot) = np.asarray(batch.column("fold").to_pylist()), features.read(batch)
            for m in models:
                mine = np.flatnonzero(fold == m.fold)
                if len(mine):
                    said = names[m.classes[m.shares(m.design(numbers[mine], hot[mine])).argmax(axis=1)]]
                    some = batch.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array([m.left_out] * len(mine)), pa.array(said.tolist(), pa.string())], names=[*kept, "left_out", "predicted"])

    told = (rows if ident else data).mapInArrow(judge, schema)
    return told.select(*(F.col(f"i{i}").alias(c) for i, c in enumerate(ident)), *([] if ident else ["times"]), "fold", F.col("y").alias(label), "left_out", "predicted"), models, features


def out_of_fold(folded: DataFrame, categorical: list[str], numeric: list[str], label: str, ident: str) -> DataFrame:
    """(ident, fold, label, predicted): each fold by a model of the others."""
    return predictions(folded, {}, label, ident, categorical=categorical, numeric=numeric)[0].drop("left_out")


def ablations(folded: DataFrame, groups: dict[str, tuple[list[str], list[str]]], label: str, ident: str) -> DataFrame:
    """Accuracy out of fold with each group of features (name to categorical and numeric) left out, and with all."""
    told = predictions(folded, groups, label)[0]
    right = F.sum(F.when(F.col(label).eqNullSafe(F.col("predicted")), F.col("times")).otherwise(0))
    return told.groupBy("left_out").agg((right / F.sum("times")).alias("accuracy"))
