"""Connected components of an edge table, all in joins and aggregates.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014).  Every step is written to the shared folder, so a lost executor
costs one step at most; only whether all components are stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v"), F.col("u")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("m").alias("u"), F.col("b").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    near = edges.join(low, "v")
    return near.select(F.col("m").alias("u"), F.col("u").alias("v")).union(low.select(F.col("m"), F.col("v"))).filter("u < v")


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, which is no larger end itself: then every component is a star around its smallest node."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("as_v"), F.lit(0).alias("as_u")).union(edges.select("u", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.sum("as_v") + F.max("as_u")).alias("n")).filter("n > 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node of an edge and the smallest node that it is connected with.

    Loops and repeated edges are allowed; an edge with a null end is left out.
    """
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(ends.distinct(), "edges")
    while not _stars(now):
        then = written(_small_star(_large_star(now)).distinct(), "edges")
        remove(now)
        now = then
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select("u", "u").distinct())
