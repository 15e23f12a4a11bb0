"""Shared scratch space: tables written where every executor and the driver can read them.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the
master is local (tests) is a temporary folder made and recorded in the session.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = "file://" + tempfile.mkdtemp(prefix="nucleogrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/nucleogrid"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path; nothing is ever overwritten, so a retried or repeated job can't mix runs."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files behind a table of ``written`` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/nucleogrid/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Gives a worker's freed memory back, as the worker lives on beside others of its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library at hand has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves Spark's default.
ARROW_BYTES = "8m"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the bytes of their batches: 10,000 long texts are too much for one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, (root, known)))
