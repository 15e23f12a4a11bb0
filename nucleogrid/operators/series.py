"""Operators along an order: fills, offsets, runs, moving values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def good_fill(value: Column, good: Column, part: list[str], order: str) -> Column:
    """The last good value, before the first good one the next.  Both frames grow, so a partition is gone through twice, not squared."""
    v, w = F.when(good, value), Window.partitionBy(*part)
    before = F.last(v, True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, F.last(v, True).over(w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)))


def back_fill(value: Column, good: Column, part: list[str], order: str) -> Column:
    """The next good value, behind the last good one the last."""
    v, w = F.when(good, value), Window.partitionBy(*part)
    behind = F.last(v, True).over(w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(behind, F.last(v, True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def last_good_descending(value: Column, good: Column, part: list[str], order: str) -> Column:
    """The last good value coming from the far end, 0 before there is one."""
    w = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(good, value), True).over(w), F.lit(0.0))


def running(value: Column, part: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def log_step(value: Column, part: list[str], order: str) -> Column:
    """Difference of the logarithms of the next value and this one; the logarithm of what isn't positive counts as 0."""
    following = F.lead(value).over(Window.partitionBy(*part).orderBy(order))
    log = lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(0.0))
    return F.when(following.isNotNull(), log(following) - log(value))


def moving_average(df: DataFrame, value: str, part: list[str], order: str, width: int = 7, times: int = 1) -> DataFrame:
    """Centred means of full windows only, applied again and again: the edges get lost."""
    half = width // 2
    for _ in range(times):
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(-half, half)
        df = df.withColumn("_n", F.count("*").over(w)).withColumn(value, F.avg(value).over(w)).filter(F.col("_n") == width).drop("_n")
    return df


def monotone_runs(df: DataFrame, value: str, part: list[str], order: str) -> DataFrame:
    """Runs of rising, falling and level steps: (part, run, kind, first, last, n)."""
    w = Window.partitionBy(*part).orderBy(order)
    step = df.withColumn("kind", F.signum(F.col(value) - F.lag(value).over(w)).cast("int")).filter("kind IS NOT NULL")
    islands = step.withColumn("_new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w))
    return islands.groupBy(*part, "run", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def median3_forward(value: str, part: list[str], order: str) -> Column:
    """Lower median of this value and the next two, fewer at the end."""
    held = F.array_sort(F.collect_list(value).over(Window.partitionBy(*part).orderBy(order).rowsBetween(0, 2)))
    return F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int"))


def with_zscore(df: DataFrame, value: str, part: list[str], name: str) -> DataFrame:
    """Adds the z-score within each part: the parts' moments are aggregated and joined, so a large part is no single task's work."""
    stats = df.groupBy(*part).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(stats, part).withColumn(name, (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def local_maxima(df: DataFrame, value: str, axes: list[str]) -> DataFrame:
    """Rows whose value is the largest within one step on every axis, by a maximum along one axis after the other."""
    out = df.withColumn("_m", F.col(value))
    for a in reversed(axes):
        out = out.withColumn("_m", F.max("_m").over(Window.partitionBy(*(x for x in axes if x != a)).orderBy(a).rangeBetween(-1, 1)))
    return out.filter(F.col("_m") == F.col(value)).drop("_m")


def complete_only(df: DataFrame, value: str, member: str) -> DataFrame:
    """Rows whose value occurs with as many members as any value does, the value re-based to 1."""
    counts = df.groupBy(value).agg(F.countDistinct(member).alias("_n"))
    most = counts.agg(F.max("_n").alias("_n"))
    full = df.join(counts.join(F.broadcast(most), "_n").select(value), value)
    low = full.agg(F.min(value).alias("_low"))
    return full.crossJoin(F.broadcast(low)).withColumn("rebased", F.col(value) - F.col("_low") + 1).drop("_low")
