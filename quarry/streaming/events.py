"""Event streams: windows, sessions, duplicates, timeouts, rate limits, replay.

Functions on DataFrames work on batch and streaming input alike unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of their schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp: watermarks need one, and the tables hold none with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, size: str, *keys: str, late: str = LATE, slide: str | None = None) -> DataFrame:
    """Counts and sums of windows; with slide they overlap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    total = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(total, 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str, late: str = LATE) -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_of(events: DataFrame, *keys: str, late: str = LATE) -> DataFrame:
    """One event for each key: the earliest in batch, the first to arrive within the watermark in a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stale(events: DataFrame, key: str, now: DataFrame, idle: str) -> DataFrame:
    """Keys whose last event is older than the idle time; now is one row of one column, so broadcast."""
    last = events.groupBy(key).agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    clock = now.toDF("_now")
    return last.crossJoin(F.broadcast(clock)).where(F.col("last_seen") < F.col("_now") - F.expr(f"INTERVAL {idle}")).drop("_now")


def replay(events: DataFrame, after: int, most: int) -> DataFrame:
    """The next most events after a cursor, which itself is left out."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(most)


def lost(events: DataFrame, cursor: int) -> DataFrame:
    """Whether the log no longer holds the event that follows the cursor."""
    return events.agg((F.min("event_id") > cursor + 1).alias("lost"), F.min("event_id").alias("earliest"))


def stream_order(ids: Column) -> Column:
    """A stream id 'ms-n' as a sortable pair; one number would collide for large n."""
    return F.struct(F.substring_index(ids, "-", 1).cast("long").alias("ms"), F.substring_index(ids, "-", -1).cast("long").alias("n"))


def requeue(tasks: DataFrame, now: Column, idle: str, tries: int = 2) -> DataFrame:
    """Queued tasks that waited too long and were tried less than tries times; the rest of the stale ones fail."""
    late = tasks.where((F.col("status") == "QUEUED") & (F.col("queued_at") < now - F.expr(f"INTERVAL {idle}")))
    return late.withColumn("action", F.when(F.col("attempts") < tries, "REQUEUE").otherwise("FAIL"))


def last_state(events: DataFrame, key: str, status: str = "event_type") -> DataFrame:
    """The status after a key's events, and whether it was ever one of the given before."""
    return events.groupBy(key).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


RATE_SCHEMA = "user_id long, event_id long, ts timestamp, place long, allowed boolean"


def rate_limited(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Fixed windows that begin with a key's first hit, not with the clock; at most so many hits pass in each.

    A key's hits are folded as a stream sorted by time: only the window's start and count are kept,
    so a key may hold any share of the rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, count = None, None, 0
        span = timedelta(seconds=seconds)
        for f in frames:
            place, allowed = [], []
            for u, t in zip(f["user_id"], f["ts"], strict=True):
                if u != user or t >= start + span:
                    user, start, count = u, t, 0
                count += 1
                place.append(count)
                allowed.append(count <= most)
            yield f.assign(place=place, allowed=allowed)

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return rows.mapInPandas(run, RATE_SCHEMA)


def token_bucket(events: DataFrame, rate: float, burst: float, scale: float = 1.0) -> DataFrame:
    """Allowed if a token is left; tokens refill with time, at scale of the rate when degraded.  Streaming or batch."""
    rate = rate * scale

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (burst, None)
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            allowed = []
            for t in f["ts"]:
                now = t.timestamp()
                if last is not None:
                    level = min(burst, level + max(0.0, now - last) * rate)
                last = now
                allowed.append(level >= 1.0)
                if level >= 1.0:
                    level -= 1.0
            yield pd.DataFrame({"user_id": key[0], "event_id": f["event_id"], "allowed": allowed})
        state.update((level, last))

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def heartbeats(events: DataFrame, idle_seconds: int, late: str = LATE) -> DataFrame:
    """A row for each key that was silent for so long in event time, from a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="s")]})
            return
        last = state.get[0] if state.exists else 0.0
        for f in frames:
            last = max(last, f["ts"].max().timestamp())
        state.update((last,))
        state.setTimeoutTimestamp(int((max(last, state.getCurrentWatermarkMs() / 1000) + idle_seconds) * 1000) + 1)
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "last_seen": pd.Series([], dtype="datetime64[ns]")})

    rows = events.select("user_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_seen timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def durations(traces: DataFrame) -> DataFrame:
    """Counts and durations of nodes by outcome."""
    return traces.groupBy("node", "outcome").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY millis)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY millis)").alias("p95"))


def idle_frames(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """key, at: a heartbeat frame for every so many seconds without an event between two events of a key; an event at that very moment comes first."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    micros, step = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    gaps = events.select(key, micros.alias("_from"), F.lead(micros).over(w).alias("_to"))
    n = F.expr(f"(_to - _from - 1) div {step}")
    frames = gaps.where(n >= 1).select(key, F.explode(F.sequence(F.col("_from") + step, F.col("_from") + n * step, F.lit(step).cast("long"))).alias("_at"))
    return frames.select(key, F.timestamp_micros("_at").alias("at"))
