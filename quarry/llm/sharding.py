"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, given by an offset and a
skip from hashes of its name.  Shards take turns (a shard of weight w takes w turns a round), each
claiming the next free slot in its order of preference, until the table is full.  Shares differ by
little, and when a shard goes away few other slots change hands.  The table has SLOTS rows whatever
the input is, so it is broadcast; placing a key is one hash and one look-up.

Defined results: a null key is placed like any other key (by the hash of null); equal keys go to one
shard; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, free

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(64))


def _hash(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=8).digest(), "big")


def table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the index of its shard.  slots is prime and at least the number of shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, no fewer than the shards, is needed")
    if len(set(shards)) < len(shards):
        raise ValueError("shards need different names")
    place = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    out = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while out[place[i]] >= 0:
                    place[i] = (place[i] + skip[i]) % slots
                out[place[i]] = i
                left -= 1
                if not left:
                    return out
    return out


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, *, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with the columns slot, shard and shard_name (renamed with a trailing _ where those exist)."""
    names = [free(n, rows.columns) for n in ("slot", "shard", "shard_name")]
    filled = list(enumerate(table(shards, slots, weights)))
    lookup = rows.sparkSession.createDataFrame([(s, i, shards[i]) for s, i in filled], f"`{names[0]}` int, `{names[1]}` int, `{names[2]}` string")
    return rows.withColumn(names[0], slot(F.col(key), slots)).join(F.broadcast(lookup), names[0]).select(*rows.columns, *names)


def write(rows: DataFrame, key: str, path: str, **options) -> DataFrame:
    """Writes rows to one folder a shard below path, each shard's rows spread by slot over tasks, and returns what was placed."""
    placed = place(rows, key, **options)
    at, _, name = placed.columns[-3:]
    placed.repartition(at).write.partitionBy(name).parquet(path)
    return placed


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes")), "doc_id")
    return placed.select("doc_id", F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"), "slot", "shard", "shard_name")
