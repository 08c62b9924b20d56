"""Versioned tables and the handover from replay to live: failures half-way, conflicts, restarts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from quarry.sources import versions as V
from quarry.streaming import handover as H


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def numbers(spark, *values):
    return spark.createDataFrame([(v, f"x{v}") for v in values], "id long, text string")


def test_versions_conflicts_and_retention(spark, tmp_path):
    t = V.Table(spark, str(tmp_path / "t"))
    assert t.version() is None and t.numbers() == []
    with pytest.raises(LookupError):
        t.read()
    first = t.replace(numbers(spark, 1, 2, 3))
    second = t.replace(t.read().where("id > 1"))  # from itself
    assert (first.number, second.number, second.rows) == (0, 1, 2)
    assert ids(t.read()) == [2, 3] and ids(t.read(0)) == [1, 2, 3]
    with pytest.raises(V.Conflict):
        t.replace(numbers(spark, 9), after=first)
    assert ids(t.read()) == [2, 3] and t.numbers() == [0, 1]
    t.replace(numbers(spark))
    assert ids(t.read()) == [] and t.read().columns == ["id", "text"]
    assert t.retain(2) == [1, 2] and ids(t.read(1)) == [2, 3]
    with pytest.raises(LookupError):
        t.read(0)
    assert len([p for p in (tmp_path / "t" / "data").iterdir()]) == 2


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    t = V.Table(spark, str(tmp_path / "t"))
    t.replace(numbers(spark, 1, 2, 3))
    failing = spark.range(0, 100, numPartitions=4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="lost"):
        t.replace(failing)
    assert t.numbers() == [0] and ids(t.read()) == [1, 2, 3]
    assert t.retain(1) == [0] and ids(t.read()) == [1, 2, 3]  # and what the failed one has left goes


def test_log(spark, tmp_path):
    t = V.Table(spark, str(tmp_path / "log"))
    for a in range(0, 50, 10):
        t.append(numbers(spark, *range(a, a + 10)), "id")
    assert t.append(numbers(spark), "id").rows == 50
    with pytest.raises(ValueError, match="come after"):
        t.append(numbers(spark, 3), "id")
    with pytest.raises(ValueError, match="schema"):
        t.append(spark.range(60, 61), "id")
    small = t.trimmed(23)
    assert ids(t.read()) == list(range(27, 50)) and small.rows == 23 and len(small.parts) == 3
    t.append(numbers(spark, 50, 51), "id")
    assert ids(t.read()) == list(range(27, 52))
    assert t.trimmed(25).rows == 25 and t.trimmed(1000).rows == 25
    t.retain(1)
    assert ids(t.read()) == list(range(27, 52))
    assert t.trimmed(0).rows == 0 and ids(t.read()) == []


def log(spark, path, first, last, parts):
    spark.range(first, last, numPartitions=parts).select(F.col("id").alias("event_id"), F.concat(F.lit("e"), "id").alias("text")).write.mode("append").parquet(path)


def test_restart_gives_neither_gap_nor_double(spark, tmp_path, monkeypatch):
    path, sink, state = (str(tmp_path / x) for x in ("log", "sink", "state"))
    log(spark, path, 0, 40, 3)
    seen = lambda: sorted(r.event_id for r in H.held(spark, sink, spark.read.parquet(path)).collect())
    got = H.followed(spark, path, sink, state, after=9)
    assert sorted(r.event_id for r in got.collect()) == list(range(10, 40)) == seen()
    log(spark, path, 40, 70, 3)

    # the stream dies in its second batch, after that batch has been written but before it is known to be done
    parquet, calls = DataFrameWriter.parquet, []

    def dies(self, path, *args, **more):
        parquet(self, path, *args, **more)
        calls.append(path)
        if len([p for p in calls if "live-" in p]) == 2:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(Exception, match="lost"):
            H.followed(spark, path, sink, state, after=9)
    assert len(seen()) == len(set(seen())) < 60
    log(spark, path, 70, 75, 1)
    H.followed(spark, path, sink, state, after=9)
    assert seen() == list(range(10, 75))
    H.followed(spark, path, sink, state, after=9)
    assert seen() == list(range(10, 75))


def test_replay_again_after_it_was_lost(spark, tmp_path):
    """The mark is down, the replay is half done, and the log has grown: the same events are replayed, the rest is live."""
    path, sink, state = (str(tmp_path / x) for x in ("log", "sink", "state"))
    log(spark, path, 0, 20, 2)
    assert H.mark(spark, spark.read.parquet(path), state, "event_id") == 19
    log(spark, path, 20, 30, 1)
    got = H.followed(spark, path, sink, state)
    assert sorted(r.event_id for r in got.collect()) == list(range(30))
    assert H.mark(spark, spark.read.parquet(path), state, "event_id") == 19
