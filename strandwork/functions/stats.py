"""Intervals, set measures and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) for n = 0."""
    m = n.cast("double")
    p = k.cast("double") / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    den = F.sqrt((a + b) * (a + c) * (d + b) * (d + c))
    return F.when(den > 0, (a * d - b * c) / den).otherwise(0.0)


def mcnemar_p(b: int, c: int) -> float:
    """Exact binomial below 25 discordant pairs, else chi-square with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt(max(abs(b - c) - 1, 0) ** 2 / n / 2))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function."""

    def cdf(t: float) -> float:
        # Simpson's rule on the density from 0
        n, h = 2000, abs(t) / 2000
        if not h:
            return 0.5
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
        s = f(0) + f(abs(t)) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
        return 0.5 + math.copysign(s * h / 3, t)

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def running_counts(df: DataFrame, value: str, buckets: int = 4096) -> DataFrame:
    """(value, n, upto): rows with each different value, and rows with it or a lesser one; nulls are left out.

    Values are counted first; their sums run within buckets of the range, and over the buckets' totals, so no task orders the table.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    share = (F.col(value) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    placed = counts.join(F.broadcast(ends)).withColumn("__b", F.floor(share * (buckets - 1)).cast("int")).drop("__lo", "__hi")  # ends is one row
    totals = placed.groupBy("__b").agg(F.sum("n").alias("__m")).withColumn("__a", F.sum("__m").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__m"))  # at most `buckets` rows
    within = F.sum("n").over(Window.partitionBy("__b").orderBy(value))
    return placed.withColumn("__w", within).join(F.broadcast(totals), "__b").select(value, "n", (F.col("__a") + F.col("__w")).alias("upto"))


def t_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with its interval by Student's t; a single value is its own interval."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {m: t_quantile(0.5 + level / 2, int(m) - 1) for m in set(n) if m > 1}
        return n.map(lambda m: known.get(m, 0.0))

    a = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    half = quantile("n") * F.col("sd") / F.sqrt("n")
    return a.withColumn("half", half).select(*keys, "n", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def bootstrap_corr(df: DataFrame, key: str, x: str, y: str, replicates: int = 2000, seed: int = 1729) -> DataFrame:
    """Spearman's correlation with its percentile interval over resamples drawn by a hash of (replicate, place, seed); one row.

    Draws are integers of a hash, so reruns agree.  A resample is ranked within itself, equal values by
    their mean rank, and weighted by how often each row was drawn; constant resamples don't count.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    n = known.count()
    rows = known.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))  # the points of one figure
    draws = rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    drawn = F.when(F.col("replicate") == 0, F.col("i")).otherwise((F.pmod(F.xxhash64("replicate", "i", F.lit(seed)), F.lit(max(n, 1))) + 1).cast("int"))  # replicate 0 is the table itself
    counts = draws.select("replicate", drawn.alias("i")).groupBy("replicate", "i").agg(F.count("*").alias("c")).join(rows, "i")
    mean_rank = lambda v: F.sum("c").over(Window.partitionBy("replicate").orderBy(v)) - (F.sum("c").over(Window.partitionBy("replicate", v)) - 1) / 2.0
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    ranked = counts.select("replicate", "c", mean_rank("x").alias("a"), mean_rank("y").alias("b"))
    s = ranked.groupBy("replicate").agg(F.sum("c").alias("m"), *[F.sum(v).alias(k) for k, v in (("sa", c * a), ("sb", c * b), ("saa", c * a * a), ("sbb", c * b * b), ("sab", c * a * b))])
    m, va, vb = F.col("m"), F.col("saa") - F.col("sa") ** 2 / F.col("m"), F.col("sbb") - F.col("sb") ** 2 / F.col("m")
    rho = F.when((va > 1e-9) & (vb > 1e-9), (F.col("sab") - F.col("sa") * F.col("sb") / m) / F.sqrt(va * vb))
    each = s.select("replicate", rho.alias("r"))
    resampled = F.when(F.col("replicate") > 0, F.col("r"))
    return each.agg(F.round(F.max(F.when(F.col("replicate") == 0, F.col("r"))), 9).alias("rho"), F.count(resampled).alias("replicates"), F.percentile(resampled, F.lit(0.025)).alias("low"), F.percentile(resampled, F.lit(0.975)).alias("high"))
