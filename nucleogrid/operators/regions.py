"""Atlas lookups and the structure ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def annotated(points: DataFrame, atlas: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the region id of their voxel, 0 outside."""
    return points.join(atlas, keys, "left").withColumn("rid", F.coalesce("rid", F.lit(0)))


def ancestors(ontology: DataFrame) -> DataFrame:
    """(id, ancestor, depth): each structure with every structure on its path, itself included."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return ontology.select("id", F.posexplode(parts).alias("depth", "ancestor"))


def subtree_sums(values: DataFrame, ontology: DataFrame, value: str) -> DataFrame:
    """(id, value): of each structure the sum over all structures whose path it is on."""
    per = values.groupBy("id").agg(F.sum(value).alias(value))
    return ancestors(ontology).join(per, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def deepest(ontology: DataFrame) -> DataFrame:
    """Structures that are on no other's path."""
    inner = ancestors(ontology).filter("id <> ancestor").select(F.col("ancestor").alias("id")).distinct()
    return ontology.join(inner, "id", "left_anti")


def binned(rows: DataFrame, ontology: DataFrame, bins: DataFrame, keep: bool = False) -> DataFrame:
    """Each row's id replaced by the deepest of ``bins`` (id) on its path; else kept or null."""
    hit = ancestors(ontology).join(F.broadcast(bins.select(F.col("id").alias("ancestor"))), "ancestor").groupBy("id").agg(F.max_by("ancestor", "depth").alias("bin"))
    return rows.join(hit, "id", "left").withColumn("bin", F.coalesce("bin", F.col("id") if keep else F.lit(None)))


def roi_stats(voxels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of each region but 0: the truncated sum, that over the number of voxels, and the mean."""
    return voxels.filter("rid <> 0").groupBy(*by, "rid").agg(F.floor(F.sum(value)).cast("long").alias("total"), (F.floor(F.sum(value)) / F.count("*")).alias("density"), F.avg(value).alias("mean"))
