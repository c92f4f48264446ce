"""Statistics of counts, as native expressions where Spark has the functions.

The complementary error function is missing from Spark's; it is an Arrow UDF, meant for the few
rows that are left after aggregation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Normal quantiles of the two interval conventions.
Z_EXACT, Z_ROUNDED = 1.959963984540054, 1.96


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(v))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """Continuity-corrected; 0 without discordant pairs."""
    n = b + c
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1.0, 2) / n)


def mcnemar_p(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(mcnemar_chi2(b, c) / 2)))


def _log_factorial(n: Column) -> Column:
    """By Stirling's series; good to 12 digits from 100 on."""
    return n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n)


def sign_test(b: Column, c: Column) -> Column:
    """Exact two-sided p of a split b to c: twice the lower tail of fair coin flips, at most 1.

    Up to 1000 flips of the rarer side terms are summed from the first, by their ratios, of over 1000 flips in logarithms.
    Beyond, they are summed downward from the last, over 24 standard deviations: what is left out is less
    than a double shows, and memory grows with the root of the counts."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    few = F.when((k >= 1) & (k <= 1000), F.sequence(F.lit(1), F.least(k, F.lit(1000.0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    unit = F.pow(F.lit(0.5), F.least(n, F.lit(1000.0)))

    def grow(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    short = F.aggregate(few, F.struct(unit.alias("term"), unit.alias("sum")), grow, lambda acc: acc["sum"])  # no rounding while terms are exact
    start = F.struct((-n * F.lit(math.log(2.0))).alias("log"), F.exp(-n * F.lit(math.log(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    near = F.when(n <= 1000, short).otherwise(F.aggregate(few, start, step, lambda acc: acc["sum"]))
    big, rare = F.greatest(n, F.lit(200.0)), F.greatest(k, F.lit(100.0))
    top = _log_factorial(big) - _log_factorial(rare) - _log_factorial(F.greatest(big - rare, F.lit(100.0))) - big * math.log(2.0)
    down = F.when(k > 1000, F.sequence(F.lit(0), F.least(k - 1, 12 * F.sqrt(n)).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def fall(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    far = F.exp(top) * F.aggregate(down, first, fall, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(k <= 1000, near).otherwise(far)))


def wilson(successes: Column, n: Column, z: float = Z_EXACT) -> Column:
    """(low, high), within 0 and 1; (0, 0) for no trials."""
    p = F.try_divide(successes.cast("double"), n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    some = F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))
    return F.when(n == 0, F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))).otherwise(some)


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """(z, p) of two independent shares with pooled error; (0, 1) where there is none."""
    pool = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.coalesce(F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), se), F.lit(0.0))
    return F.struct(z.alias("z"), F.when(z == 0, F.lit(1.0)).otherwise(erfc(F.abs(z) / math.sqrt(2.0))).alias("p"))


def change_verdict(low: Column, high: Column, delta: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(low > 0, "improved").when(high < 0, "degraded").when(delta == 0, "unchanged").otherwise("inconclusive")


def softmax_chunk_mean(chunks: Column) -> Column:
    """Equal-weight mean of chunks' score arrays, place by place."""
    n = F.size(chunks)
    width = F.size(F.get(chunks, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(chunks, F.lit(0.0), lambda a, c: a + F.get(c, i)) / n)


def premise_chunks(tokens: Column, hypothesis_tokens: Column, limit: int, special: int = 3) -> Column:
    """A premise's tokens in chunks that leave room for the hypothesis; no room is an error."""
    budget = F.lit(limit) - hypothesis_tokens - F.lit(special)
    room = F.when(budget < 1, F.raise_error(F.lit("hypothesis leaves no room for the premise")).cast("int")).otherwise(budget)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), room)
    return F.transform(starts, lambda s: F.slice(tokens, s, room))
