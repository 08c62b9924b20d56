"""Writing: keyed merges, versioned documents, snapshots, publication."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows without a partner, and the new ones; among new rows of one key the last by all columns wins."""
    last = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("_v")).select(*keys, "_v.*")
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def merged(old: DataFrame, new: DataFrame, key: str, updatable: tuple[str, ...]) -> DataFrame:
    """Updates only the columns on the list, where the new value is known; new keys come in whole."""
    n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns), F.lit(True).alias("_is_new"))
    both = old.withColumn("_is_old", F.lit(True)).join(n, F.col(key) == F.col(f"_n_{key}"), "full")

    def value(c: str):
        fresh = F.col(f"_n_{c}")
        if c in updatable:
            return F.coalesce(fresh, F.col(c))
        return F.when(F.col("_is_old"), F.col(c)).otherwise(fresh)

    return both.select(*((F.coalesce(F.col(c), F.col(f"_n_{c}")) if c == key else value(c)).alias(c) for c in old.columns))


def clashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents whose checksum and version another key has already."""
    o = old.select("checksum", "version", F.col("logical_key").alias("known_key"))
    return new.join(o, ["checksum", "version"]).where(F.col("known_key") != F.col("logical_key"))


def without_version(points: DataFrame, document_id: str) -> DataFrame:
    return points.where(~F.col("document_id").eqNullSafe(document_id))


def published(points: DataFrame, document_id: str) -> DataFrame:
    hit = (F.col("document_id") == document_id) & (F.col("status") == "PROCESSING")
    return points.withColumn("status", F.when(hit, "ACTIVE").otherwise(F.col("status")))


def appended_vocabulary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose token and id are both unseen."""
    return new.join(old.select("token"), "token", "left_anti").join(old.select("token_id"), "token_id", "left_anti").select(*old.columns)


def safe_key(key: str) -> str:
    """A storage key below its root, or an error."""
    clean = posixpath.normpath(key)
    if not key or key.startswith("/") or clean.startswith("..") or "\\" in key or "\0" in key or ":" in key:
        raise ValueError(f"bad storage key {key!r}")
    return clean


def write_version(df: DataFrame, root: str, version: str) -> int:
    """Writes a version beside the others, reads it back, and only then points to it."""
    spark = df.sparkSession
    path = f"{root}/{safe_key(version)}"
    df.write.parquet(path)
    n, m = df.count(), spark.read.parquet(path).count()
    if n != m:
        raise RuntimeError(f"{m} of {n} rows were written to {version}")
    spark.createDataFrame([(version, m)], "version string, n long").coalesce(1).write.mode("overwrite").json(f"{root}/_current")
    return m


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string, n long").json(f"{root}/_current").first()["version"]
    return spark.read.parquet(f"{root}/{safe_key(version)}")


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces just the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def reloaded(df: DataFrame, path: str) -> DataFrame:
    """Replaces a table by df as a whole and reads it back; df must not come from that table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingestion_reports(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One report for each document: its chunks, those without a sparse vector, those published, and how the attempt ended.

    A file that cannot be read in principle is unsupported, which is not a failure of the process.
    """
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count(F.when(F.coalesce("n_terms", F.lit(0)) == 0, 1)).alias("empty_sparse_chunks"), F.count(F.when(F.col("status") == "ACTIVE", 1)).alias("published_count"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "empty_sparse_chunks", "published_count")]
    ok = F.col("error_summary").isNull()
    return documents.join(n, "document_id", "left").select("document_id", "status", *counts, ok.alias("ok"), (~ok & ~F.col("has_text_layer")).alias("unsupported"), "error_summary")


def write_reports(reports: DataFrame, path: str) -> DataFrame:
    """Reports as JSON lines, read back."""
    reports.write.mode("overwrite").json(path)
    return reports.sparkSession.read.schema(reports.schema).json(path)
