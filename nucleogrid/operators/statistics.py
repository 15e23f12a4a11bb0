"""Group statistics, tests, corrections, percentiles, samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..workers import with_checkpoints


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def welch(a: str = "a_", b: str = "b_") -> tuple[Column, Column]:
    """t and degrees of freedom from columns n, mean and sd of two groups."""
    va, vb = (F.col(f"{p}sd") ** 2 / F.col(f"{p}n") for p in (a, b))
    t = (F.col(f"{a}mean") - F.col(f"{b}mean")) / F.sqrt(va + vb)
    return t, (va + vb) ** 2 / (va**2 / (F.col(f"{a}n") - 1) + vb**2 / (F.col(f"{b}n") - 1))


def pooled(a: str = "a_", b: str = "b_") -> tuple[Column, Column]:
    """t and degrees of freedom of the two-sample test with equal variances."""
    df = F.col(f"{a}n") + F.col(f"{b}n") - 2
    var = ((F.col(f"{a}n") - 1) * F.col(f"{a}sd") ** 2 + (F.col(f"{b}n") - 1) * F.col(f"{b}sd") ** 2) / df
    return (F.col(f"{a}mean") - F.col(f"{b}mean")) / F.sqrt(var * (1 / F.col(f"{a}n") + 1 / F.col(f"{b}n"))), df.cast("double")


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, float).copy() for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + gamma(a + b) - gamma(a) - gamma(b)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
        out = np.where(x <= 0, 0.0, front * h)
    return np.where(turn, 1 - out, out)


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    ok = t.notna() & df.notna()
    out = pd.Series(np.nan, index=t.index)
    out[ok] = incomplete_beta(df[ok] / 2, np.full(int(ok.sum()), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    return out


def with_bh(df: DataFrame, p: str, part: list[str], tie: str, name: str = "q", dependent: bool = False) -> DataFrame:
    """Adds p-values adjusted by Benjamini and Hochberg, or for dependent tests by Benjamini and Yekutieli.

    The adjusted value is the least of m p / rank over this and larger p, 1 at most; both frames grow with their order.
    """
    up = Window.partitionBy(*part).orderBy(p, tie)
    sized = df.join(df.groupBy(*part).agg(F.count(p).alias("_m")), part)
    ranked = sized.withColumn("_r", F.row_number().over(up))
    if dependent:
        harmonic = sized.groupBy(*part).agg(F.first("_m").alias("_k")).select(*part, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("_k", F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + 1.0 / i).alias("_f"))
        ranked = ranked.join(harmonic, part)
    raw = ranked.withColumn("_raw", (F.col("_f") if dependent else F.lit(1.0)) * F.col("_m") * F.col(p) / F.col("_r"))
    down = Window.partitionBy(*part).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(name, F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw", "_m", "_r", "_f")


def stars(q: Column) -> Column:
    return sum(((q < t).cast("int") for t in (0.05, 0.01, 0.001, 0.0001)), F.lit(0))


def within_sigma(df: DataFrame, value: str, part: list[str], k: float, closed: bool) -> DataFrame:
    """Rows no more (closed) or less than k population standard deviations from the mean of their part."""
    stats = df.groupBy(*part).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    far = F.abs(F.col(value) - F.col("_m")) - k * F.col("_s")
    return df.join(stats, part).withColumn("_far", far).filter(F.col("_far") <= 0 if closed else F.col("_far") < 0).drop("_far", "_m", "_s")


def percentile_nearest_rank(df: DataFrame, value: str, part: list[str], p: float) -> DataFrame:
    """The value of rank ceil(n p)."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") == F.greatest(F.ceil(F.col("_n") * p), F.lit(1))).select(*part, F.col(value).alias("p"))


def percentile_half_sample(df: DataFrame, value: str, part: list[str], p: float) -> DataFrame:
    """Linear between samples that stand at (i - 1/2) / n, clamped at the ends."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w)).withColumn("_at", F.least(F.greatest(F.col("_n") * p + 0.5, F.lit(1.0)), F.col("_n").cast("double")))
    near = ranked.withColumn("_w", F.greatest(1 - F.abs(F.col("_r") - F.col("_at")), F.lit(0.0))).filter("_w > 0")
    return near.groupBy(*part).agg(F.sum(F.col(value) * F.col("_w")).alias("p"))


def percentile_floor_rank(df: DataFrame, value: str, part: list[str], p: float) -> DataFrame:
    """The value of rank floor(n p), of rank 1 at least."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") == F.greatest(F.floor(F.col("_n") * p), F.lit(1))).select(*part, F.col(value).alias("p"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def mutual_best(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are the best of either end: the highest score, of equals the smallest other end."""
    best = lambda k, other: pairs.groupBy(k).agg(F.max(F.struct(score, (-F.col(other)).alias("o"))).alias("m")).select(k, (-F.col("m.o")).alias(other))
    return pairs.join(best(a, b), [a, b]).join(best(b, a), [b, a])


def one_to_one(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Greedy assignment: the best pair left, again and again; of equals that with the smallest ends.

    All pairs that are the best of both their ends are taken at once, which gives the same result
    as one after the other, as no later pair could have come between.  Each round is a checkpoint.
    """
    with_checkpoints(pairs.sparkSession)
    total = F.struct(F.col(score), (-F.col(a)).alias("na"), (-F.col(b)).alias("nb"))
    left, out = pairs.select(a, b, score).checkpoint(), None
    while not left.isEmpty():
        ranked = left.withColumn("_k", total)
        tops = ranked.join(ranked.groupBy(a).agg(F.max("_k").alias("_a")), a).join(ranked.groupBy(b).agg(F.max("_k").alias("_b")), b)
        won = tops.filter("_k = _a AND _k = _b").select(a, b, score).checkpoint()
        out = won if out is None else out.unionByName(won)
        left = left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti").checkpoint()
    return pairs.select(a, b, score).limit(0) if out is None else out
