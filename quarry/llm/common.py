"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir.  Only where that is unset (tests, a local master)
    is a folder of this process made, and removed when it ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


#: Spark's setting that removes a query's shuffle files when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, whoever computed it may be lost.

    small: it takes little disk: zstd, and the shuffle files that it was made from go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    if small:
        spark.conf.set(TIDY, "true")
    try:
        (df.write.option("compression", "zstd") if small else df.write).parquet(path)
    finally:
        if small:
            spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path  # noqa: SLF001
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table that written() made; nothing may read it any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


#: Tables of up to this many narrow rows are told to all tasks; larger ones are joined by a shuffle, with the same result.
TOLD = 500_000


def hinted(df: DataFrame, most: int = TOLD) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def is_plain(df: DataFrame) -> bool:
    """Whether df is a read of files, column for column: whatever stands above a read may repeat or change its rows."""
    plan = df._jdf.queryExecution().analyzed()  # noqa: SLF001
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.row_index")  # Parquet has it
    except AnalysisException:
        return False
    return True


def plain(df: DataFrame, name: str) -> DataFrame:
    """df if it is a read of files, else df written."""
    return df if is_plain(df) else written(df, name, small=True)


def numbered(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """df, or these columns of it, with a number for each row, which a lost executor or a second run does not change: its file's number and its place in the file."""
    from pyspark.sql import functions as F

    df = plain(df, "rows")
    columns = columns or df.columns
    place = df.select(*columns, F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(name))
    files = place.select(f"{name}_file").distinct().orderBy(f"{name}_file").collect()  # a row for each file
    known = df.sparkSession.createDataFrame([(r[0], i << 40) for i, r in enumerate(files)], f"{name}_file string, {name}_first long")
    out = place.join(hinted(known), f"{name}_file")
    return out.select(*columns, (F.col(f"{name}_first") + F.col(name)).alias(name))


def free(name: str, taken) -> str:
    """name, with as many trailing _ as are needed to differ from the names taken."""
    while name in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of an Arrow batch of about limit bytes of text each, with their texts; only a slice's texts are copied."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    whole = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = whole[at - 1] if at else 0
        end = int(np.searchsorted(whole, before + limit)) + 1
        yield batch.slice(at, end - at), utf8(texts.slice(at, end - at))
        at = end
    pa.default_memory_pool().release_unused()  # a worker lives on and keeps what it once needed


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's setting for the bytes of an Arrow batch, and its default.
BATCH, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless their own path has it.

    Arrow batches are bounded by bytes too, unless the session says otherwise: to 4 MB, for each of a stage's workers and tasks holds several.
    """
    import os
    from pathlib import Path

    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, "4m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
