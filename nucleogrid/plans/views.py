"""Instance tables made from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance per order: tile, centre and inclusive box."""
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 4).alias("brain"), (k % 3).alias("tile_x"), (F.floor(k / 3) % 3).alias("tile_y"), k.alias("label"), (F.lit(8) + k % 40).alias("volume"), (F.lit(2) + k % 3).alias("h"),
        ((k * 31) % 200).alias("cz"), (F.floor(F.col("o_totalprice") / 100) % 500).alias("cy"), ((k * 7919) % 500).alias("cx"),
    )
    return base.select("*", *((F.col(f"c{a}") - F.col("h")).alias(f"{a}0") for a in "zyx"), *((F.col(f"c{a}") + F.col("h")).alias(f"{a}1") for a in "zyx"))


BOXES = """base AS (SELECT o_custkey % 4 AS brain, o_orderkey % 3 AS tile_x, CAST(floor(o_orderkey / 3) AS BIGINT) % 3 AS tile_y, o_orderkey AS label,
    8 + o_orderkey % 40 AS volume, 2 + o_orderkey % 3 AS h, (o_orderkey * 31) % 200 AS cz, CAST(floor(o_totalprice / 100) AS BIGINT) % 500 AS cy, (o_orderkey * 7919) % 500 AS cx FROM orders),
boxes AS (SELECT *, cz - h AS z0, cy - h AS y0, cx - h AS x0, cz + h AS z1, cy + h AS y1, cx + h AS x1 FROM base)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voxel per line item."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), F.floor("l_quantity").alias("z"), F.floor(F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_partkey") % 128).alias("x"), F.col("l_extendedprice").alias("v"), F.col("l_discount").alias("w"))


VOXELS = """voxels AS (SELECT l_orderkey AS label, CAST(floor(l_quantity) AS BIGINT) AS z, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS y, l_partkey % 128 AS x, l_extendedprice AS v, l_discount AS w FROM lineitem)"""


def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth label is merged into that 9 further on, where both are of a brain."""
    own = boxes(spark, sf_dir).select("brain", "label")
    return own.filter("label % 5 = 0").select("brain", F.col("label").alias("src"), (F.col("label") + 9).alias("dst")).join(own.select("brain", F.col("label").alias("dst")), ["brain", "dst"])


REMAP = "remap AS (SELECT a.brain, a.label AS src, b.label AS dst FROM boxes a JOIN boxes b ON a.brain = b.brain AND b.label = a.label + 9 WHERE a.label % 5 = 0)"


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shift per event: tile, z in the order of time, tx; implausible beyond 60."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("tile"), F.row_number().over(Window.partitionBy(F.col("user_id") % 9).orderBy("ts", "event_id")).cast("long").alias("z"), (F.col("value") - 100).alias("tx"), "value", "event_id", "event_type")


SHIFTS = "shifts AS (SELECT user_id % 9 AS tile, row_number() OVER (PARTITION BY user_id % 9 ORDER BY ts, event_id) AS z, value - 100 AS tx, value, event_id, event_type FROM events)"


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the world as structures: root, region, nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaf = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("/root/r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit("/")).alias("path"))
    mid = r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.concat(F.lit("/root/r"), F.col("r_regionkey"), F.lit("/")).alias("path"))
    return leaf.unionByName(mid).unionByName(spark.createDataFrame([("root", "/root/")], "id string, path string"))


ONTOLOGY = """ontology AS (SELECT 'n' || n_nationkey AS id, '/root/r' || n_regionkey || '/n' || n_nationkey || '/' AS path FROM nation
    UNION ALL SELECT 'r' || r_regionkey, '/root/r' || r_regionkey || '/' FROM region UNION ALL SELECT 'root', '/root/')"""


def regions(df: DataFrame) -> DataFrame:
    """The region of a box: a block of 50 voxels a side."""
    f = lambda c: F.floor(F.col(c) / 50)
    return df.withColumn("rid", ((f("cz") * 100 + f("cy") * 10 + f("cx")) % 25).cast("long"))


def atlas(spark: SparkSession) -> DataFrame:
    """(bz, by, bx, rid) of each block."""
    return spark.range(4 * 10 * 10).select(F.floor(F.col("id") / 100).alias("bz"), (F.floor(F.col("id") / 10) % 10).alias("by"), (F.col("id") % 10).alias("bx"), (F.col("id") % 25).cast("long").alias("rid"))


REGIONED = "regioned AS (SELECT *, CAST((floor(cz / 50) * 100 + floor(cy / 50) * 10 + floor(cx / 50)) AS BIGINT) % 25 AS rid FROM boxes)"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of suppliers by nation, gene and pair."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", (F.col("s_nationkey") % 2).cast("long").alias("gene"), (F.col("n_regionkey") % 2).cast("long").alias("gender"), F.floor(F.col("s_nationkey") / 2).alias("pair"), F.col("n_regionkey").cast("long").alias("roi"), F.col("s_acctbal").alias("value"))


COHORT = "cohort AS (SELECT s_suppkey, CAST(s_nationkey % 2 AS BIGINT) AS gene, CAST(n_regionkey % 2 AS BIGINT) AS gender, CAST(floor(s_nationkey / 2) AS BIGINT) AS pair, CAST(n_regionkey AS BIGINT) AS roi, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
