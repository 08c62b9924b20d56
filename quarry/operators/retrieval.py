"""Hybrid retrieval: filters, dense and sparse top-k, rank fusion, gates, completion of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
FUSED, FINAL = 30, 8
DENSE_FLOOR, RERANK_FLOOR = 0.60, 0.07
TABLE_ROWS = 12
#: Rows that are scored at once.
SCORED = 1024


def effective(start: Column, end: Column, day: Column) -> Column:
    """Closed interval; an open end has no bound."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def permitted(chunks: DataFrame, *, roles: tuple[str, ...] = (), day: date | None = None, status: str | None = "ACTIVE", documents: tuple[str, ...] = (), types: tuple[str, ...] = (), departments: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that a principal may see, filtered before anything is scored."""
    out = chunks
    for column, values in (("document_id", documents), ("document_type", types), ("department", departments), ("classification", classes)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if status:
        out = out.where(F.col("status") == status)
    if roles:
        out = out.where(F.arrays_overlap("allowed_roles", F.array(*map(F.lit, roles))))
    return out.where(effective(F.col("effective_from"), F.col("effective_to"), F.lit(day))) if day else out


def dense_top(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, block: int = 512) -> DataFrame:
    """query_id, key, score, rank by cosine; a zero vector scores 0; the query's own row takes part.

    Queries go out in blocks of proven size.  SCORED rows are scored by one matrix product and only a
    task's k best rows for each query leave it.
    """
    spark, parts = vectors.sparkSession, []
    held = []
    for row in queries.select("query_id", vector).toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(_dense_block(spark, vectors, held, key, vector, k))
            held = []
    if held or not parts:
        parts.append(_dense_block(spark, vectors, held, key, vector, k))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _dense_block(spark, vectors: DataFrame, rows: list, key: str, vector: str, k: int) -> DataFrame:
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    matrix = unit(np.array([r[vector] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        keys, scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in (b.iloc[i : i + SCORED] for b in batches for i in range(0, len(b), SCORED)):
            b = b[b[vector].notna()]
            if not len(b) or not len(ids):
                continue
            score = np.round(matrix @ unit(np.stack(b[vector].to_numpy()).astype(np.float64)).T, 6) + 0.0
            keys = np.concatenate([keys, np.broadcast_to(b[key].to_numpy(np.int64), score.shape)], axis=1)
            scores = np.concatenate([scores, score], axis=1)
            best = np.lexsort((keys, -scores), axis=1)[:, :k]
            keys, scores = np.take_along_axis(keys, best, axis=1), np.take_along_axis(scores, best, axis=1)
        yield pd.DataFrame({"query_id": np.repeat(ids, keys.shape[1]), key: keys.ravel(), "score": scores.ravel()})

    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInPandas(run, f"query_id long, {key} long, score double")


def best_over_queries(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.max("score").alias("score"))


def fused(lists: list[DataFrame], query: str, key: str, *, k: int = RRF_K, most: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, ranks from 1, ties by key."""
    rows = lists[0].select(query, key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(query, key, "rank"))
    # 1 / (k + rank) as exact decimals, so that the sum does not depend on its order
    total = rows.groupBy(query, key).agg(F.round(F.sum(F.round(1.0 / (k + F.col("rank")), 12).cast("decimal(20,12)")).cast("double"), 12).alias("rrf"))
    w = Window.partitionBy(query).orderBy(F.desc("rrf"), key)
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def reranked(hits: DataFrame, score: Callable[[DataFrame], DataFrame] | None, query: str, key: str, *, floor: float = RERANK_FLOOR, final: int = FINAL) -> DataFrame:
    """Scores the fused queue by the given function (adds rerank), drops what is below the floor, keeps the best; without one, the order stays."""
    if score is None:
        return hits.where(F.col("place") <= final)
    w = Window.partitionBy(query).orderBy(F.desc("rerank"), key)
    return score(hits).where(F.col("rerank") >= floor).withColumn("place", F.row_number().over(w)).where(F.col("place") <= final)


def rewritten(question: str, rewrite: Callable[[str], list[str]] | None = None, most: int = 3) -> list[str]:
    """The question, then at most so many rewrites that keep its numbers; a failing rewriter gives none."""
    import re

    wanted = set(re.findall(r"[0-9]+(?:\.[0-9]+)?", question))
    try:
        more = rewrite(question) if rewrite else []
    except Exception:  # noqa: BLE001  a model's failure only costs its rewrites
        more = []
    kept = [q for q in more if wanted <= set(re.findall(r"[0-9]+(?:\.[0-9]+)?", q))][:most]
    return list(dict.fromkeys([question, *kept]))


def unseen_topics(words: DataFrame, vocabulary: DataFrame, general: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """query_id, token: general words of a question that the vocabulary does not cover.

    Covered means equal to a token, part of one or holding one; substrings are matched by their
    pieces of three characters instead of comparing all pairs.
    """
    asked = words.where(~F.col("token").isin(*stop)) if stop else words
    asked = asked.join(general.select("token"), "token", "left_semi").distinct()

    def pieces(token: Column) -> Column:
        return F.when(F.length(token) < 3, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))

    left = asked.select("query_id", "token", F.explode(pieces(F.col("token"))).alias("piece"))
    right = vocabulary.select(F.col("token").alias("known"), F.explode(F.array_distinct(pieces(F.col("token")))).alias("piece"))
    covered = left.join(right, "piece").where(F.col("known").contains(F.col("token")) | F.col("token").contains(F.col("known"))).select("query_id", "token").distinct()
    return asked.join(covered, ["query_id", "token"], "left_anti")


def refused(best: DataFrame, unseen: DataFrame, *, floor: float = DENSE_FLOOR) -> DataFrame:
    """query_id, refused: best dense score below the floor, or a topic that was never seen."""
    topics = unseen.groupBy("query_id").agg(F.count("*").alias("n_unseen"))
    return best.join(topics, "query_id", "full").select("query_id", ((F.coalesce("best", F.lit(0.0)) < floor) | (F.coalesce("n_unseen", F.lit(0)) > 0)).alias("refused"))


def valid_payloads(points: DataFrame, required: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """Points whose payload is a JSON object with all required text fields, which become columns; others are left out whole."""
    parsed = points.withColumn("_p", F.from_json(payload, ", ".join(f"`{x}` string" for x in required)))
    known = parsed.where(F.col("_p").isNotNull())
    for x in required:
        known = known.where(F.col(f"_p.{x}").isNotNull())
    return known.select(*(c for c in points.columns if c != payload and c not in required), *(F.col(f"_p.{x}").alias(x) for x in required))


def counted(points: DataFrame, **filters) -> DataFrame:
    """n, n_all: points that pass the filters of permitted(), and all."""
    kept = permitted(points, **filters).agg(F.count("*").alias("n"))
    return kept.crossJoin(points.agg(F.count("*").alias("n_all")))  # one row each


def scrolled(points: DataFrame, vectors: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """All points with their payload; the vectors are not read."""
    return points.drop(*vectors)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list], *, key: str, text: str = "text", size: int = 16) -> DataFrame:
    """key, embedding: texts go to the model in batches of size; a batch that comes back with another count is an error that names it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), size):
                some = f[text].iloc[at : at + size].fillna("").tolist()
                vectors = embed(some)
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts from {key} {f[key].iloc[at]} on")
                out.extend(vectors)
            yield pd.DataFrame({key: f[key], "embedding": out})

    return texts.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, embedding array<double>")


TABLE = ["document_id", "section", "caption"]


def table_positions(rows: DataFrame) -> DataFrame:
    """Each table row's place (from 1) and its table's number of rows."""
    w = Window.partitionBy(*TABLE)
    return rows.withColumn("row_no", F.row_number().over(w.orderBy("char_start", "chunk_id"))).withColumn("n_rows", F.count("*").over(w))


def completed(hits: DataFrame, rows: DataFrame, *, query: str | None = None, most: int = TABLE_ROWS, cap: int = FUSED) -> DataFrame:
    """Hits with the missing rows of partly found tables; added rows have no score and are marked.

    The cap is the size of one answer's additions, by the order of table and place: of each query where
    hits name one in the column query, else of all hits together.
    """
    placed = table_positions(rows)
    own = [query] if query else []
    hit = hits.select(*own, "chunk_id").distinct()
    found = placed.join(hit, "chunk_id").groupBy(*own, *TABLE).agg(F.count("*").alias("covered"), F.first("n_rows").alias("total"))
    partly = found.where((F.col("covered") > 0) & (F.col("covered") < F.col("total")) & (F.col("total") <= most)).select(*own, *TABLE)
    added = placed.join(partly, TABLE).join(hit, [*own, "chunk_id"], "left_anti")
    if query:
        w = Window.partitionBy(query).orderBy(*TABLE, "row_no")
        added = added.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    else:
        added = added.orderBy(*TABLE, "row_no").limit(cap)
    added = added.select(*own, "chunk_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("expanded"))
    return hits.select(*own, "chunk_id", "score", F.lit(False).alias("expanded")).unionByName(added)


__all__ = ["best_over_queries", "completed", "counted", "dense_top", "effective", "embedded", "fused", "permitted", "refused", "reranked", "rewritten", "scrolled", "table_positions", "unseen_topics", "valid_payloads"]
