"""Operators on objects and voxels beyond joins of boxes: contrast, matching of names, chunks, moments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..workers import on_workers
from .statistics import percentile_nearest_rank


def contrast(df: DataFrame, value: str, part: list[str], low: float, high: float) -> DataFrame:
    """Values stretched between two nearest-rank percentiles of their part to 0 and 1; 0.001 apart at least."""
    ends = percentile_nearest_rank(df, value, part, low).withColumnRenamed("p", "_low").join(percentile_nearest_rank(df, value, part, high).withColumnRenamed("p", "_high"), part)
    scaled = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(0.001))
    return df.join(ends, part).withColumn(value, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_low", "_high")


def compressed(score: Column, limit: float) -> Column:
    """Beyond the limit a score grows by the logarithm of what is over."""
    size = F.abs(score)
    return F.when(size > limit, F.signum(score) * (limit + F.log10(size - limit + 1))).otherwise(score)


def pattern(text: str) -> str:
    """The anchored regular expression of a printf pattern: %0Nd and %d are numbers."""
    return "^" + r"(\d+)".join(map(re.escape, re.split(r"%(?:0\d+)?d", text))) + "$"


def parsed(df: DataFrame, name: str, text: str, fields: list[str]) -> DataFrame:
    """Rows whose name fits a printf pattern, with its numbers."""
    p = pattern(text)
    return df.filter(F.col(name).rlike(p)).withColumns({f: F.regexp_extract(name, p, i + 1).cast("long") for i, f in enumerate(fields)})


def combinations(spark: SparkSession, markers: int) -> DataFrame:
    """(class, code, positives) of each combination of markers, those with fewer positives first."""
    k = spark.range(1 << markers)
    bits = [F.pmod(F.shiftright("id", i), F.lit(2)) for i in range(markers)]
    out = k.select("id", F.concat(*(b.cast("string") for b in bits)).alias("code"), F.bit_count("id").alias("positives"))
    return out.select(F.row_number().over(Window.orderBy("positives", "id")).alias("class"), "code", "positives")


def in_range(z: Column, low: Column, most: Column) -> Column:
    """low <= z < most, where -1 stands for no end."""
    return (z >= low) & ((most == -1) | (z < most))


def known(text: Column) -> Column:
    """A number from a text in which '-' and 0 stand for nothing."""
    return F.nullif(F.nullif(text, F.lit("-")).cast("double"), F.lit(0.0))


def cascade(p1: Column, p2: Column, p3: Column, p4: Column, sure: float, margin: float) -> Column:
    """The first class that is sure; else of the second and third the clearer one; else the first or the rest."""
    return F.when(p1 > sure, 1).when(p2 > sure, 2).when(p3 > sure, 3).when(p2 - p3 > margin, 2).when(p3 - p2 > margin, 3).when(p1 > p4, 1).otherwise(4)


def unique_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a with their one row of b; several are an error, and so is none."""
    many = F.raise_error(F.concat_ws(" ", F.lit("not one row of"), *(F.col(k).cast("string") for k in keys)))
    one = b.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in b.columns if c not in keys))).alias("_row"))
    joined = a.join(one, keys, "left").withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(many))
    return joined.select(*a.columns, "_row.*")


def placed_neighbour(tiles: DataFrame) -> DataFrame:
    """(brain, i, j, from_i, from_j): each tile with the neighbour that it is placed by, the left one before the upper one."""
    own = lambda p: tiles.select("brain", F.col("i").alias(f"{p}i"), F.col("j").alias(f"{p}j"))
    left = tiles.join(own("l").withColumns({"i": F.col("li"), "j": F.col("lj") + 1}), ["brain", "i", "j"], "left")
    both = left.join(own("u").withColumns({"i": F.col("ui") + 1, "j": F.col("uj")}), ["brain", "i", "j"], "left")
    return both.select("brain", "i", "j", F.coalesce("li", "ui").alias("from_i"), F.coalesce("lj", "uj").alias("from_j")).filter("from_i IS NOT NULL")


def group_difference(df: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: relative change from side 0 to side 1 of a value, and t with equal variances; groups with two rows a side only."""
    of = lambda f, k: f(F.when(F.col("side") == k, F.col("value")))
    s = df.groupBy(*by).agg(*(of(f, k).alias(f"{n}{k}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for k in (0, 1))).filter("n0 > 1 AND n1 > 1 AND v0 + v1 > 0")
    freedom = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / freedom
    t = (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return s.select(*by, ((F.col("m1") - F.col("m0")) / F.col("m0")).alias("change"), t.alias("t"), freedom.alias("df"))


def around(points: DataFrame, image: DataFrame, keep: list[str]) -> DataFrame:
    """Pixels (y, x, ...) of the 3 by 3 neighbourhood of each point that are in the image."""
    step = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    near = points.select(*keep, F.explode(F.transform(step, lambda s: F.col("y") + s)).alias("y"), "x").select(*keep, "y", F.explode(F.transform(step, lambda s: F.col("x") + s)).alias("x"))
    return near.join(image, ["y", "x"])


_SECOND = [(a, b) for i, a in enumerate("zyx") for b in "zyx"[i:]]


def second_moments(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Voxels and the population covariances of their coordinates, of each group."""
    return voxels.groupBy(*by).agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in _SECOND))


def _axes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        m = np.zeros((len(rows), 3, 3))
        for a, b in _SECOND:
            m[:, "zyx".index(a), "zyx".index(b)] = m[:, "zyx".index(b), "zyx".index(a)] = rows[f"c{a}{b}"]
        values, vectors = np.linalg.eigh(m)
        values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
        for k in range(3):
            rows[f"m{k + 1}"] = values[:, k]
            rows[f"d{k + 1}"] = 2 * np.sqrt(5 * values[:, k])
            rows[f"a{k + 1}"] = list(vectors[:, :, k])
        yield rows.drop(columns=[f"c{a}{b}" for a, b in _SECOND])


def principal_axes(moments: DataFrame) -> DataFrame:
    """Moments m1 >= m2 >= m3 of each ellipsoid, its equivalent diameters d1 to d3 and its unit axes a1 to a3 (z, y, x)."""
    on_workers(moments.sparkSession)
    keys = ", ".join(f"{c} {t}" for c, t in moments.dtypes if c not in {f"c{a}{b}" for a, b in _SECOND})
    return moments.mapInPandas(_axes, keys + "".join(f", m{k} double, d{k} double, a{k} array<double>" for k in (1, 2, 3)))


def mode_filled(df: DataFrame, value: str) -> DataFrame:
    """Nulls of a column become its most frequent value, of equally frequent ones the smallest."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    mode = n.agg(F.max(F.struct("_n", (-F.col(value)).alias("_v"))).alias("_m")).select((-F.col("_m._v")).alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(value, F.coalesce(value, "_mode")).drop("_mode")


def spaced(df: DataFrame, value: str, n: int) -> DataFrame:
    """n equally spaced whole numbers from the least to the largest value."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.col("a") + (F.col("b") - F.col("a")) * i / float(n - 1)).cast("long"))
    return ends.select(F.explode(at).alias(value)).distinct()


def file_places(df: DataFrame, name: str) -> DataFrame:
    """Place, slice and channel from the names of aligned, stitched and resampled files; the last have no slice."""
    z, c = F.regexp_extract(name, r"_(\d{4})_", 1), F.regexp_extract(name, r"_C(\d+)_", 1)
    return df.select("*", F.regexp_extract(name, r"_(aligned|stitched|resampled)\.", 1).alias("place"), F.nullif(z, F.lit("")).cast("long").alias("z"), c.cast("long").alias("channel"))


def in_chunks(df: DataFrame, at: str, size: int, overlap: int, chunks: int) -> DataFrame:
    """Rows with each chunk that holds them; ``own`` in the one of them that keeps them, the last."""
    step = size - overlap
    last = F.least(F.floor(F.col(at) / step), F.lit(chunks - 1).cast("long"))
    first = F.greatest(F.ceil((F.col(at) - size + 1) / step), F.lit(0).cast("long"))
    return df.filter(F.col(at) < step * (chunks - 1) + size).withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == last)


def split_by_list(df: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Rows with the part that their name is listed for; a name on no list is an error."""
    unknown = F.raise_error(F.concat(F.lit("on no list: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.join(lists, key, "left").withColumn("part", F.coalesce("part", unknown))


def rescaled_labels(voxels: DataFrame, factor: int) -> DataFrame:
    """Labels on a coarser grid; where several fall on a voxel the largest stays."""
    return voxels.groupBy(*(F.floor(F.col(a) / factor).alias(a) for a in "zyx")).agg(F.max("label").alias("label"))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class and the weight that gives all classes the same share."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return n.crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_all") / (F.col("n") * F.col("_k"))).drop("_all", "_k")


def clustered(df: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """(key, cluster) by k-means with cosine distance; vectors without direction have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = df.filter(F.exists(vector, lambda v: v != 0)).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(usable).transform(usable).select(key, F.col("prediction").alias("cluster"))
