"""Writers of instance tables and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PARTITIONS = ["brain", "tile_x", "tile_y"]


def instances(df: DataFrame, path: str) -> None:
    """Instance tables lie by brain and tile."""
    df.write.partitionBy(*PARTITIONS).mode("overwrite").parquet(path)


def upserted(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows and the new ones whose key isn't known; of new rows of a key one stays."""
    fresh = new.join(known.select(key), key, "left_anti")
    one = fresh.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in new.columns if c != key)))).filter("_k = 1").drop("_k")
    return known.unionByName(one)


def transforms_json(df: DataFrame) -> DataFrame:
    """(value) one JSON map of "i-j" to [tz, tx, ty]."""
    entry = F.struct(F.concat_ws("-", "i", "j").alias("key"), F.array("tz", "tx", "ty").alias("value"))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def _exists(df: DataFrame, path: str) -> bool:
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)


def csv_beside(df: DataFrame, path: str) -> str:
    """Writes CSV with a header to ``path``, or where that is taken to path_1, path_2 and so on; nothing is overwritten.  Returns the place."""
    at, n = path, 0
    while _exists(df, at):
        n += 1
        at = f"{path}_{n}"
    df.write.mode("errorifexists").csv(at, header=True)
    return at


def boxes(df: DataFrame, path: str) -> None:
    """Boxes of instances lie by brain and tile, beside the instances."""
    df.select(*PARTITIONS, "label", "z0", "y0", "x0", "z1", "y1", "x1").write.partitionBy(*PARTITIONS).mode("overwrite").parquet(path)


def vertices_csv(df: DataFrame, path: str) -> None:
    """Points (z, y, x) as CSV with the columns X, Y, Z."""
    df.select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z")).write.mode("errorifexists").csv(path, header=True)


def published(df: DataFrame, out: str, step: str) -> str:
    """Results of a step, by brain: <out>/<step>/brain=<brain>.  Only brains of these rows are replaced."""
    at = f"{out.rstrip('/')}/{step}"
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("brain").mode("overwrite").parquet(at)
    return at


def measures(tables: dict[str, DataFrame], folder: str) -> None:
    """A table for each measure (volume, counts, density, cortex), where others have the sheets of one file."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name.lower()}")
