"""Readers of the tables around an image run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLESHEET = "brain string, pair string, tile_x int, tile_y int, tile_dir string, image_dir string, device string"


def samplesheet(spark: SparkSession, path: str) -> DataFrame:
    """A row per tile; a missing brain or tile_dir is an error, a missing pair is 'pair', a missing tile 0."""
    raw = spark.read.schema(SAMPLESHEET).csv(path, header=True)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"samplesheet: {c} is missing"))).otherwise(F.col(c)).alias(c)
    return raw.select(need("brain"), F.coalesce("pair", F.lit("pair")).alias("pair"), F.coalesce("tile_x", F.lit(0)).alias("tile_x"), F.coalesce("tile_y", F.lit(0)).alias("tile_y"), need("tile_dir"), "image_dir", "device")


def coarse_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, tz, tx, ty) from a JSON map of "i-j" to three numbers."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("tile", "t"))
    ij = F.split("tile", "-")
    return entry.select(ij[0].cast("int").alias("i"), ij[1].cast("int").alias("j"), F.get("t", F.lit(0)).alias("tz"), F.get("t", F.lit(1)).alias("tx"), F.get("t", F.lit(2)).alias("ty"))


def refine_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(z, i, j, tx, ty) from a JSON list, over z, of maps of "i-j" to two numbers."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.posexplode(F.from_json("value", "array<map<string, array<double>>>")).alias("z", "m")).select("z", F.explode("m").alias("tile", "t"))
    ij = F.split("tile", "-")
    return entry.select("z", ij[0].cast("int").alias("i"), ij[1].cast("int").alias("j"), F.get("t", F.lit(0)).alias("tx"), F.get("t", F.lit(1)).alias("ty"))


def json_map(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, key of the map, value) of each entry of a JSON object."""
    return df.select(key, F.explode(F.from_json(column, "map<string, string>")).alias("key", "value"))


def path_table(df: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """Numbers in file names, by pattern, each re-based so that its smallest is 1."""
    for field, pattern in fields.items():
        df = df.withColumn(field, F.regexp_extract(name, pattern, 1).cast("long"))
    low = df.agg(*(F.min(f).alias(f"_{f}") for f in fields))
    return df.crossJoin(F.broadcast(low)).withColumns({f: F.col(f) - F.col(f"_{f}") + 1 for f in fields}).drop(*(f"_{f}" for f in fields))


def file_walk(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length, modificationTime) of files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def ontology_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col("structure_id").alias("id"), F.col("structure_id_path").alias("path"), "abbreviation", F.col("depth").cast("int").alias("depth"))
