"""Replay, then live: a batch read of a log up to a mark, and a stream from there on, into one sink without gap or double.

The log is a folder of Parquet files with a growing sequence number.  The first run takes the highest number of the log as its
mark, writes all events after the cursor up to the mark as one part of the sink, and puts the mark down beside it; then the
stream of the folder goes on with events above the mark.  Whatever is run again finds what is there:

* the mark is put down once, by a rename that fails if it is there, before anything is replayed, so a restart replays the same events;
* each part of the sink has a name that depends on what it holds (the replay, or the stream's batch) and is written as a whole,
  overwriting what a failed attempt has left; Spark runs a batch again with the same number and the same files.

Events that reach the log late with a number below the mark are not in the stream: a log gives out numbers in order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.versions import Conflict, Table, Version


def mark(spark: SparkSession, log: DataFrame, state: str, seq: str) -> int:
    """The number up to which events are replayed, the same for every run."""
    table = Table(spark, f"{state}/mark")
    known = table.version()
    if known is None:
        top = log.agg(F.coalesce(F.max(seq).cast("long"), F.lit(-1))).first()[0]
        try:
            return table.commit(Version(0, "", (), None, top)).rows
        except Conflict:
            known = table.version()
    return known.rows


def replayed(log: DataFrame, sink: str, *, seq: str, after: int, until: int) -> None:
    log.where((F.col(seq) > after) & (F.col(seq) <= until)).write.mode("overwrite").parquet(f"{sink}/part=replay")


def live(spark: SparkSession, path: str, sink: str, state: str, *, schema, seq: str, above: int, per_trigger: int = 1, once: bool = True) -> StreamingQuery:
    """The stream above the mark; once: what is there now, then it ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/part=live-{number:09d}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).where(F.col(seq) > above)
    out = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 second")).start()


def followed(spark: SparkSession, path: str, sink: str, state: str, *, seq: str = "event_id", after: int = -1, per_trigger: int = 1) -> DataFrame:
    """Replays the log at path after a cursor, follows it to its present end, and returns the sink's events."""
    log = spark.read.parquet(path)
    top = mark(spark, log, state, seq)
    replayed(log, sink, seq=seq, after=after, until=top)
    live(spark, path, sink, state, schema=log.schema, seq=seq, above=max(top, after), per_trigger=per_trigger).awaitTermination()
    return held(spark, sink, log)


def held(spark: SparkSession, sink: str, like: DataFrame) -> DataFrame:
    """The sink's events, without what is only there to name its parts."""
    try:
        return spark.read.schema(like.schema).option("basePath", sink).parquet(sink).select(*like.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
