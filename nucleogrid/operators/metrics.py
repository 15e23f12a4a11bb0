"""Agreement of two labellings of the same voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def contact(a: DataFrame, b: DataFrame, voxel: list[str]) -> DataFrame:
    """(ta, tb, n): how many voxels have both labels."""
    return a.join(b, voxel).groupBy("ta", "tb").agg(F.count("*").alias("n"))


def ious(contacts: DataFrame) -> DataFrame:
    of = lambda c: F.sum("n").over(Window.partitionBy(c))
    return contacts.withColumn("iou", F.col("n") / (of("ta") + of("tb") - F.col("n")))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and average precision from tp, fp and fn."""
    share = lambda *c: F.round(F.col("tp") / F.nullif(sum((F.col(x) for x in c), F.lit(0)), F.lit(0)), 6)
    return counts.select("tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tp", "fp", "fn").alias("ap"))
