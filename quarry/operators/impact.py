"""Sparse top-k over postings in impact blocks, with upper bounds that let most of them be skipped.

A posting is (token, key, w).  The postings of a token are cut into bands of similar weight, and a band into parts of about BLOCK
rows by a hash of the key; a question's token meets a token's postings part by part, so a common token is many tasks.
A block's greatest weight bounds what it can add to a score, a token's greatest weight what the token can.

1. Threshold: a question's rarest tokens, with about SEED postings, give partial scores.  Weights are positive, so the
   k-th of them is a lower bound of the k-th score.
2. Essential tokens: those with the least bounds, as long as their sum stays below the threshold, cannot lift a row over it
   alone.  The postings of the others give the candidates; a block is left out if its bound and all other tokens'
   bounds together stay below the threshold, and a row whose partial score and the rest's bounds do.
3. Completion: what the other tokens add is looked up for candidates only, by (token, key).

The result is that of adding up all postings (sums rounded to DIGITS), ties by key.  Rows without a token in common do not
appear; a token that stands twice in a question counts twice; null tokens meet nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import settled

#: Bands of a unit of weight, rows of a part, postings of the first look, places of a score.
BANDS, BLOCK, SEED, DIGITS = 8, 65_536, 4_000, 6
#: Below a threshold by so much is below it for sure, however sums are rounded.
SLACK = 1e-5


@dataclass
class Impact:
    """rows: token, band, part, key, w; blocks: token, band, n, top, parts."""

    rows: DataFrame
    blocks: DataFrame
    key: str


def build(postings: DataFrame, key: str) -> Impact:
    """postings: key, token, w > 0."""
    known = postings.where((F.col("w") > 0) & F.col("token").isNotNull()).select("token", key, F.col("w").cast("double").alias("w"))
    rows = settled(known.withColumn("band", F.floor(F.col("w") * BANDS).cast("int")))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = settled(rows.groupBy("token", "band").agg(F.count("*").alias("n"), F.max("w").alias("top")).withColumn("parts", parts))
    return Impact(rows, blocks, key)


def met(index: Impact, asked: DataFrame, query: str) -> DataFrame:
    """query, key, part of the score: asked (query, token, q, band, parts) with the postings of its blocks."""
    large = index.blocks.where("parts > 1").select("token", "band", "parts")
    rows = index.rows.join(large, ["token", "band"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(index.key), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    # a table has a known size: Spark broadcasts it if that is small and shuffles it otherwise; so do the small tables below
    spread = settled(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    return spread.join(rows, ["token", "band", "part"]).groupBy(query, index.key).agg(F.sum(F.col("q") * F.col("w")).alias("partial"))


def kth(scores: DataFrame, query: str, by: Column, k: int) -> DataFrame:
    """query, threshold: the k-th best; questions with fewer rows are left out."""
    best = scores.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(by.desc()))).where(F.col("_n") == k)
    return best.select(query, by.alias("threshold"))


def search(index: Impact, asked: DataFrame, query: str, k: int = 20) -> DataFrame:
    """query, key, score, rank.  asked: query, token, q > 0."""
    key = index.key
    tokens = index.blocks.groupBy("token").agg(F.sum("n").alias("n"), F.max("top").alias("most"))
    mine = asked.where((F.col("q") > 0) & F.col("token").isNotNull()).groupBy(query, "token").agg(F.sum("q").alias("q"))
    mine = mine.join(tokens, "token").withColumn("bound", F.col("q") * F.col("most"))
    rare = Window.partitionBy(query).orderBy("n", "token").rowsBetween(Window.unboundedPreceding, -1)
    mine = settled(mine.withColumn("before", F.coalesce(F.sum("n").over(rare), F.lit(0))))
    blocks = mine.join(index.blocks.select("token", "band", "top", "parts"), "token")

    first = met(index, blocks.where(F.col("before") < SEED).select(query, "token", "q", "band", "parts"), query)
    threshold = settled(kth(first, query, F.col("partial"), k))

    least = Window.partitionBy(query).orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0)
    split = mine.join(threshold, query, "left").withColumn("below", F.sum("bound").over(least)).withColumn("total", F.sum("bound").over(Window.partitionBy(query)))
    floor = F.coalesce(F.col("threshold") - SLACK, F.lit(0.0))
    split = settled(split.withColumn("floor", floor).withColumn("essential", F.col("below") >= F.col("floor")))
    wide = split.where("essential").join(index.blocks.select("token", "band", "top", "parts"), "token")
    wide = wide.where(F.col("q") * F.col("top") + F.col("total") - F.col("bound") >= F.col("floor"))
    found = met(index, wide.select(query, "token", "q", "band", "parts"), query)

    rest = split.groupBy(query).agg(F.first("floor").alias("floor"), F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).alias("rest"))
    candidates = settled(found.join(rest, query).where(F.col("partial") + F.col("rest") >= F.col("floor")).select(query, key, "partial"))

    others = split.where("not essential").select(query, "token", "q")
    looked = candidates.select(query, key).join(others, query)
    again = others.select("token").distinct()
    added = looked.join(index.rows.join(again, "token", "left_semi").select("token", key, "w"), ["token", key]).select(query, key, (F.col("q") * F.col("w")).alias("partial"))
    score = candidates.unionByName(added).groupBy(query, key).agg(F.round(F.sum("partial"), DIGITS).alias("score")).where("score > 0")
    best = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
