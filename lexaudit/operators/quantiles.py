"""Exact quantiles of groups of any size: equal values are counted, ranges of values are summed, ranks are looked up.

No task holds a group's values: a group is spread over ranges of its values, and a rank is found by the rows
before its range and the running count in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit.session import cut


def running_counts(counted: DataFrame, by: list[str], column: str, n: str = "n") -> DataFrame:
    """Adds ``upto``: rows of the group up to and with a value, in its order, and ``rows``: all of the group's."""
    shares = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    placed = cut(counted.repartitionByRange(shares, *keys, F.col(column)).withColumn("_range", F.spark_partition_id()))
    # a range is of one task's size; a group has a row a range here
    each = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_own"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    before = each.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), (F.sum("_own").over(group.orderBy("_range")) - F.col("_own")).alias("_before"), F.sum("_own").over(group).alias("rows"))
    inside = placed.withColumn("_in", F.sum(n).over(W.partitionBy("_range", *by).orderBy(column).rowsBetween(W.unboundedPreceding, 0)))
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(before, on).withColumn("upto", F.col("_before") + F.col("_in")).drop("_range", "_r", "_in", "_before", *(f"_k{i}" for i in range(len(by))))


def exact_quantiles(df: DataFrame, by: list[str], column: str, levels: list[float], weight: str | None = None) -> DataFrame:
    """(by…, q0, q1, …): values at the levels, linear between ranks, as doubles; nulls are skipped.

    A row counts ``weight`` times. Groups of nulls alone have null values; without ``by`` there is one row
    always. Equal to ``percentile`` in every bit. A job runs while the result is planned."""
    if any(not 0 <= q <= 1 for q in levels):
        raise ValueError("levels are between 0 and 1")
    one = F.lit(1) if weight is None else F.col(weight)
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_x")).agg(F.sum(one).cast("long").alias("_n"))
    placed = running_counts(values.withColumnRenamed("_n", "n"), by, "_x")
    found = []
    for i, q in enumerate(levels):
        at = F.lit(float(q)) * (F.col("rows") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("_x"))).alias(f"_{name}{i}"))
    ends = placed.groupBy(*by).agg(F.max("rows").alias("_rows"), *found)
    out = []
    for i, q in enumerate(levels):
        at = F.lit(float(q)) * (F.col("_rows") - 1)
        low, high = F.floor(at), F.ceil(at)
        between = (high - at) * F.col(f"_lo{i}") + (at - low) * F.col(f"_hi{i}")
        out.append(F.when((low == high) | (F.col(f"_lo{i}") == F.col(f"_hi{i}")), F.col(f"_lo{i}")).otherwise(between).alias(f"q{i}"))
    got = ends.select(*by, *out)
    if not by:
        return got
    return df.select(*by).distinct().alias("a").join(got.alias("b"), _same(by), "left").select(*(F.col(f"a.{c}").alias(c) for c in by), *(f"q{i}" for i in range(len(levels))))


def _same(by: list[str]) -> F.Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return on


def grouped_with_quantiles(df: DataFrame, by: list[str], column: str, levels: dict[str, float], *aggregates: F.Column) -> DataFrame:
    """One row a group: aggregates, then exact quantiles of ``column`` by name; nulls of ``by`` are a group."""
    plain = df.groupBy(*by).agg(*aggregates)
    found = exact_quantiles(df, by, column, list(levels.values()))
    named = [F.col(f"b.q{i}").alias(name) for i, name in enumerate(levels)]
    others = [F.col(f"a.`{c}`") for c in plain.columns if c not in by]
    return plain.alias("a").join(found.alias("b"), _same(by)).select(*(F.col(f"a.{c}").alias(c) for c in by), *others, *named)
