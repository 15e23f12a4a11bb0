"""What runs and people leave beside images: logs, annotations, stitching projects, stacks of instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _moment(line: Column) -> Column:
    """The time in a line such as 'Sat Feb  3 04:05:06 2024'."""
    return F.to_timestamp(F.regexp_replace(F.regexp_replace(line, r"^\s*\w+\s+", ""), r"\s+", " "), "MMM d HH:mm:ss yyyy")


def run_logs(logs: DataFrame) -> DataFrame:
    """(path, start, end, hours) of runs that ended well, from whole logs (path, value).

    The last line but one must be 'ok' (the last is empty); the third holds the start and the last
    but three the end.  Hours are those of the day's clock, whole days not counted.
    """
    lines = F.split("value", "\n")
    good = logs.withColumn("_l", lines).filter((F.size("_l") >= 4) & (F.try_element_at("_l", F.lit(-2)) == "ok"))
    timed = good.select("path", _moment(F.get("_l", F.lit(2))).alias("start"), _moment(F.try_element_at("_l", F.lit(-4))).alias("end"))
    return timed.withColumn("hours", F.pmod(F.unix_seconds("end") - F.unix_seconds("start"), F.lit(86400)) / 3600)


def annotations(texts: DataFrame) -> DataFrame:
    """(path, row, type) from whole files (path, value) with one header line 'Type' and a number a line; rows are counted from 0 in the file."""
    bad = F.raise_error(F.concat(F.lit("no column Type: "), F.col("path")))
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    body = texts.select("path", F.when(F.trim(lines[0]) == "Type", F.slice(lines, 2, F.size(lines))).otherwise(bad).alias("l"))
    return body.select("path", F.posexplode("l").alias("row", "t")).filter(F.trim("t") != "").select("path", F.col("row").cast("long").alias("row"), F.col("t").cast("int").alias("type"))


_PARTS = ("Filename", "MinX", "MinY", "MinZ")


def stitch_projects(projects: DataFrame, height: float, width: float) -> DataFrame:
    """(path, image, first, last, z, y, x) of each image of whole stitching projects (path, value).

    The folder of an image names its slices, as in Z001-Z120.  Where the project's direction is
    down, y is counted from the ``height``; where it is left, x from the ``width``.  An image that
    lacks a place is an error.
    """
    found = [F.xpath("value", F.lit(f"/*/*[1]/Image/@{p}")).alias(p) for p in _PARTS]
    whole = F.xpath_int("value", F.lit("count(/*/*[1]/Image)"))
    short = F.raise_error(F.concat(F.lit("an image lacks its name or place: "), F.col("path")))
    held = projects.select("path", F.xpath_string("value", F.lit("/*/@Direction")).alias("direction"), whole.alias("n"), *found)
    each = held.select("path", "direction", F.explode(F.when(F.least(*(F.size(p) for p in _PARTS)) == F.col("n"), F.arrays_zip(*_PARTS)).otherwise(short)).alias("i"))
    steps, number = F.split("i.Filename", r"\\"), lambda p: F.col(f"i.Min{p}").cast("double")
    slices = lambda at: F.substring(F.split(F.try_element_at(steps, F.lit(-2)), "-")[at], 2, 20).cast("long")
    flip = lambda word, size, v: F.when(F.contains("direction", F.lit(word)), size - v).otherwise(v)
    return each.select("path", F.element_at(steps, -1).alias("image"), slices(0).alias("first"), slices(1).alias("last"), number("Z").alias("z"), flip("Down", F.lit(float(height)), number("Y")).alias("y"), flip("Left", F.lit(float(width)), number("X")).alias("x"))


def instance_stacks(spark: SparkSession, folder: str, z_ratio: float, channel: str | None = None) -> DataFrame:
    """Instances of the stacks below a folder (Parquet, zmin in the name), z of their boxes scaled and counted from the stack's start.

    With a channel only rows whose column of that name is true stay; a stack without the column has none.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)
    start = F.floor(F.regexp_extract("_metadata.file_path", r"zmin(\d+)_", 1).cast("long") * z_ratio)
    placed = rows.withColumn("zmin", start).withColumns({c: F.col(c) * z_ratio + F.col("zmin") for c in ("z0", "z1")})
    if channel is None:
        return placed
    return placed.filter(F.coalesce(F.col(channel), F.lit(False))) if channel in rows.columns else placed.filter(F.lit(False))
