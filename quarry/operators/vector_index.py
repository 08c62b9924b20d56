"""Inverted-file index over vectors: rows stored by their nearest centroid, searched list by list, and an exact way beside it.

`fit` makes the centroids from a bounded sample (SAMPLE rows for each list, those of the least hash of their key); `build`
assigns every row and writes it, with its list, as a unit vector.  `search` deals rows and questions out in a grid: a
list's rows in blocks of about BLOCK, the questions that look into it in blocks of about ASKED, so that a hot list or a
popular one is many tasks of a known size.  A task is one matrix product and gives each question's k best of its block.

probes: how many of the nearest lists a question looks into; `probes_for` measures how many a wanted recall needs, as
that depends on how the vectors cluster (vectors without clusters need most of the lists).  exact=True goes on: a row of a list is at least as far
from the question as the centroid less the list's radius (angles are a metric), so all lists that could still hold a better
row than the k-th found are looked into as well, and the result is that of comparing all pairs.

Defined results: a null vector is not in the index; a zero vector has similarity 0 with everything and stands in a list of
its own, which every exact search may look into; scores are cosines rounded to 6 digits, ties by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.retrieval import unit
from quarry.sources.shared import settled

#: Sampled rows for each list, most lists (they bound what is told to tasks), rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 64, 4096, 12
BLOCK, ASKED = 8192, 2048
#: Rows of a matrix of scores that are held at once.
HELD = 256
#: Rounding of scores, and what an angle may be off by.
DIGITS, SLACK = 6, 1e-5


@dataclass
class Index:
    """rows: key, list, vector (unit, 8 bytes a number); lists: list, n, radius (greatest angle to the centroid)."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    key: str


def fit(vectors: DataFrame, *, key: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample of at most sample * lists rows; lists is about the root of the count."""
    known = vectors.where(F.col(vector).isNotNull())
    n = known.count()
    lists = max(1, min(lists or int(np.sqrt(n)), MOST_LISTS, n))
    rows = known.select(F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("_v")).orderBy(F.xxhash64("_k"), "_k").limit(sample * lists)
    held = [r["_v"] for r in rows.collect()]  # bounded by sample * lists
    if not held:
        return np.zeros((1, 1))
    points = unit(np.array(held, dtype=np.float64))
    points = points[np.abs(points).sum(axis=1) > 0]
    if not len(points):
        return np.zeros((1, len(held[0])))
    random = np.random.default_rng(20240601)
    chosen = [int(random.integers(len(points)))]
    near = 1 - points @ points[chosen[0]]
    while len(chosen) < min(lists, len(points)):  # far ones are likelier
        weight = np.maximum(near, 0)
        if weight.sum() <= 1e-12:
            break
        chosen.append(int(random.choice(len(points), p=weight / weight.sum())))
        near = np.minimum(near, 1 - points @ points[chosen[-1]])
    centroids = points[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(points @ centroids.T, axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, points)
        new = unit(total)
        empty = np.abs(new).sum(axis=1) == 0
        new[empty] = centroids[empty]
        if np.allclose(new, centroids):
            break
        centroids = new
    return centroids


def build(vectors: DataFrame, centroids: np.ndarray, *, key: str, vector: str = "embedding") -> Index:
    """Every row with a vector, in the list of its nearest centroid; written."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = unit(_matrix(b.column(1)))
            similar = m @ shared.value.T if m.shape[1] == shared.value.shape[1] else np.zeros((len(m), len(shared.value)))
            own = np.argmax(similar, axis=1)
            angle = np.arccos(np.clip(similar[np.arange(len(m)), own], -1, 1))
            zero = np.abs(m).sum(axis=1) == 0
            own[zero], angle[zero] = -1, 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(angle), pa.array([v.tobytes() for v in m], pa.binary())], names=[key, "list", "angle", "vector"])

    known = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    rows = settled(known.mapInArrow(run, f"{key} long, list int, angle double, vector binary"))
    lists = settled(rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")))
    return Index(rows.drop("angle"), lists, centroids, key)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most HELD rows at a time, as each is compared with every centroid."""
    for b in batches:
        for i in range(0, b.num_rows, HELD):
            yield b.slice(i, HELD)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; an offset or a null in the batch is as Arrow has it."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def probed(queries: DataFrame, index: Index, vector: str = "embedding") -> DataFrame:
    """query_id, vector, order (of nearness, from 0), list, angle (to the centroid): every list for every question, as one row of arrays each."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = unit(_matrix(b.column(1)))
            similar = m @ shared.value.T if m.shape[1] == shared.value.shape[1] else np.zeros((len(m), len(shared.value)))
            order = np.argsort(-similar, axis=1, kind="stable")
            angle = np.arccos(np.clip(np.take_along_axis(similar, order, axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(angle), pa.list_(pa.float64()))], names=["query_id", "vector", "lists", "angles"])

    known = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias(vector))
    return known.mapInArrow(run, "query_id long, vector binary, lists array<int>, angles array<double>")


def scored(wanted: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, key, score, n_scored: each question's k best of every block of the lists that it wants.  wanted: query_id, vector, list."""
    key = index.key
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    asked = wanted.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ASKED)).cast("int").alias("askers"))
    sizes = F.broadcast(index.lists.select("list", blocks.alias("blocks")).join(asked, "list"))  # at most MOST_LISTS + 1 rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = index.rows.join(sizes, "list").select("list", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("i"), spread(F.col("askers")).alias("j"), F.col(key).alias("row"), F.col("vector").alias("v"))
    questions = wanted.join(sizes, "list").select("list", spread(F.col("blocks")).alias("i"), F.pmod(F.xxhash64("query_id"), F.col("askers")).cast("int").alias("j"), "query_id", F.col("vector").alias("q"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "n_scored": pa.array([], pa.int64())})
        left = left.sort_by("row")
        own = left["row"].to_numpy()
        x, y = (np.stack([np.frombuffer(v, dtype=np.float64) for v in t[c].to_pylist()]) for t, c in ((left, "v"), (right, "q")))
        n = min(k, len(own))
        keys, scores = np.zeros((len(y), n), dtype=np.int64), np.zeros((len(y), n))
        for i in range(0, len(y), HELD):  # a part of the matrix at a time
            score = np.round(y[i : i + HELD] @ x.T, DIGITS) + 0.0
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            keys[i : i + HELD], scores[i : i + HELD] = own[best], np.take_along_axis(score, best, axis=1)
        told = np.zeros(keys.shape, dtype=np.int64)
        told[:, 0] = len(own)  # each block's pairs count once for a question
        return pa.table({"query_id": np.repeat(right["query_id"].to_numpy(), n), key: keys.ravel(), "score": scores.ravel(), "n_scored": told.ravel()})

    grid = ["list", "i", "j"]
    return rows.groupBy(*grid).cogroup(questions.groupBy(*grid)).applyInArrow(compare, f"query_id long, {key} long, score double, n_scored long")


def search(index: Index, queries: DataFrame, *, vector: str = "embedding", k: int = 20, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, key, score, rank, n_scored (rows compared for the question)."""
    asked = settled(probed(queries, index, vector))
    first = asked.select("query_id", "vector", F.explode(F.slice("lists", 1, probes)).alias("list"))
    found = settled(scored(first, index, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    if exact:
        kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        # the k-th score so far, as an angle; no bound while there are fewer
        worst = kept.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        bound = F.when(F.col("n") < k, F.lit(float(np.pi))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("worst") - 2 * 10.0**-DIGITS))))
        rest = asked.select("query_id", "vector", F.posexplode(F.arrays_zip("lists", "angles")).alias("place", "x")).where(F.col("place") >= probes)
        rest = rest.select("query_id", "vector", F.col("x.lists").alias("list"), F.col("x.angles").alias("angle"))
        near = rest.join(worst, "query_id", "left").join(F.broadcast(index.lists.select("list", "radius")), "list")
        near = near.where(F.col("angle") - F.col("radius") <= F.coalesce(bound, F.lit(float(np.pi))) + SLACK)
        zero = asked.select("query_id", "vector", F.lit(-1).alias("list"))
        found = found.unionByName(scored(near.select("query_id", "vector", "list").unionByName(zero), index, k))
    total = found.groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"))
    ranked = found.drop("n_scored").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(total, "query_id").select("query_id", index.key, "score", "rank", "n_scored")


def probes_for(index: Index, vectors: DataFrame, *, key: str, vector: str = "embedding", k: int = 20, share: float = 0.95, sample: int = 128) -> int:
    """How many of the nearest lists hold so much of what exact search finds, measured on at most sample rows as questions (those of the least hash)."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), vector)
    asked = settled(rows.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(sample))
    found = search(index, asked, vector=vector, k=k, exact=True).select("query_id", index.key)
    lists = F.broadcast(probed(asked, index, vector).select("query_id", "lists"))  # at most sample rows
    placed = found.join(index.rows.select(index.key, "list"), index.key).join(lists, "query_id")
    counts = {r["place"]: r["n"] for r in placed.groupBy(F.array_position("lists", F.col("list")).alias("place")).agg(F.count("*").alias("n")).collect()}  # a row for each list
    total, sofar = sum(counts.values()), 0
    for place in sorted(counts):
        sofar += counts[place]
        if sofar >= share * total:
            return max(1, int(place))
    return 1


def recall(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """query_id, n, recall: of the wanted rows of each question the share that was found."""
    hit = found.select("query_id", key, F.lit(1).alias("_hit"))
    return wanted.join(hit, ["query_id", key], "left").groupBy("query_id").agg(F.count("*").alias("n"), (F.count("_hit") / F.count("*")).alias("recall"))
