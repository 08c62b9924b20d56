"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where a cluster sets it; else, on a local master alone, a folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="quarry-shared-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


#: Spark's setting for the bytes of an Arrow batch, and its default.
BATCH, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, unless the session says otherwise: a Python worker holds several, and their values take many times their bytes."""
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, "4m")


def settled(df: DataFrame) -> DataFrame:
    """df written once and read back: what comes of it no longer depends on how a plan is run again."""
    path = f"{folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
