"""Versioned tables: immutable data folders and a manifest for each version, made visible by one rename.

root/data/<id>      Parquet files, never written again
root/manifests/<n>  one file for each version: its parts (folder, rows, and for a log the range of its order column)

A write goes to a folder of its own and is counted from what was written; only then is the manifest put beside the others under
the next number, by a rename that fails if that number is there.  So a write that fails half-way leaves the old version as it
was, readers never see a part of one, and of two writers that began from one version the second is told so (Conflict).  Old
versions are read until they are dropped; data that no remaining version names is removed with them.

A log is a table whose parts have ranges of an order column.  `append` adds a part; `trimmed` keeps the newest rows by dropping
whole parts, and of the oldest part that stays it moves the range's beginning, so no data is written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer was first."""


@dataclass(frozen=True)
class Part:
    folder: str
    rows: int
    #: Of a log: rows of the order column from low to high count.
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    parts: tuple[Part, ...] = ()
    order: str | None = None
    rows: int = field(default=0)

    @classmethod
    def parsed(cls, text: str) -> Version:
        told = json.loads(text)
        return cls(**told | {"parts": tuple(Part(**p) for p in told["parts"])})


class Table:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm  # noqa: SLF001  Hadoop's file systems have no Python API
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
        self.fs = self.path("manifests").getFileSystem(self.conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("manifests").toUri(), self.conf)
        self.no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # noqa: SLF001

    # --- versions ---

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path("manifests")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version; the newest by default, None before the first."""
        known = self.numbers()
        if number is None and not known:
            return None
        number = known[-1] if number is None else number
        if number not in known:
            raise LookupError(f"no version {number} of {self.root}")
        stream = self.fs.open(self.path(f"manifests/{number:012d}"))
        try:
            return Version.parsed(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: Version) -> Version:
        text = json.dumps(asdict(version))
        hidden = self.path(f"manifests/_{uuid.uuid4().hex}")
        out = self.fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.context.rename(hidden, self.path(f"manifests/{version.number:012d}"), self.no_options)
        except Py4JJavaError as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version.number} of {self.root} is another writer's") from None
            raise
        return version

    # --- writing ---

    def _part(self, df: DataFrame, order: str | None) -> Part:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        told = [F.count("*").alias("n"), *((f(order).cast("long").alias(k) for f, k in ((F.min, "low"), (F.max, "high"))) if order else ())]
        seen = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").agg(*told).first()
        return Part(folder, seen["n"], *((seen["low"], seen["high"]) if order else ()))

    def replace(self, df: DataFrame, *, after: Version | None = None) -> Version:
        """A new version that is df alone.  df may be read from this very table."""
        before = after or self.version()
        part = self._part(df, None)
        return self.commit(Version((before.number + 1) if before else 0, df.schema.json(), (part,), None, part.rows))

    def append(self, df: DataFrame, order: str, *, after: Version | None = None) -> Version:
        """A new version with the old parts and df; rows of a log are never older than those that it has."""
        before = after or self.version()
        if before and (before.order != order or before.schema != df.schema.json()):
            raise ValueError("a log's order column and schema stay")
        part = self._part(df, order)
        old = before.parts if before else ()
        if part.rows and (newest := max((p.high for p in old), default=None)) is not None and part.low <= newest:
            raise ValueError(f"rows from {part.low} on come after {newest}")
        parts = (*old, part) if part.rows else old
        return self.commit(Version((before.number + 1) if before else 0, df.schema.json(), parts, order, (before.rows if before else 0) + part.rows))

    def trimmed(self, last: int, *, after: Version | None = None) -> Version:
        """A new version with the newest last rows of a log."""
        before = after or self.version()
        kept, left = [], last
        for p in reversed(before.parts):
            if left <= 0:
                break
            if p.rows > left:
                # the row where the newest of this part begin; ties stay together
                low = self._rows(p, before).select(F.col(before.order).cast("long").alias("o")).orderBy(F.desc("o")).limit(left).agg(F.min("o")).first()[0]
                p = Part(p.folder, self._rows(p, before).where(F.col(before.order) >= low).count(), low, p.high)
            kept.append(p)
            left -= p.rows
        return self.commit(Version(before.number + 1, before.schema, tuple(reversed(kept)), before.order, sum(p.rows for p in kept)))

    # --- reading ---

    def _rows(self, part: Part, version: Version) -> DataFrame:
        df = self.spark.read.schema(StructType.fromJson(json.loads(version.schema))).parquet(f"{self.root}/{part.folder}")
        return df.where(F.col(version.order) >= part.low) if version.order else df

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        if version is None:
            raise LookupError(f"no version of {self.root}")
        if not version.parts:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(version.schema)))
        schema = StructType.fromJson(json.loads(version.schema))
        if not version.order:
            return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p.folder}" for p in version.parts))
        # the oldest part alone may have been trimmed; its bound holds for all, as later parts are newer
        df = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p.folder}" for p in version.parts))
        return df.where(F.col(version.order) >= min(p.low for p in version.parts))

    def retain(self, last: int) -> list[int]:
        """Drops all but the newest versions, and data that none of those names; returns the versions that remain.

        Data of a writer that has not committed yet is not named either: run this while nobody writes.
        """
        known = self.numbers()
        remaining = known[-last:] if last > 0 else known[-1:]
        named = {p.folder for n in remaining for p in self.version(n).parts}
        for n in known:
            if n not in remaining:
                self.fs.delete(self.path(f"manifests/{n:012d}"), False)
        if self.fs.exists(self.path("data")):
            for x in self.fs.listStatus(self.path("data")):
                folder = f"data/{x.getPath().getName()}"
                if folder not in named:
                    self.fs.delete(self.path(folder), True)
        return remaining
