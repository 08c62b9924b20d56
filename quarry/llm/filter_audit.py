"""Filter interaction audit: what five document filters remove alone, together, and in each of their orders.

1. Every text gives one mask of the filters A to D that it fails, and a digest.  E is a matter of the whole
   table: rows are summed by (digest, part, doc_id), then by (digest, part), and a digest's least doc_id over all
   parts tells which of them fail E.  So copies meet as partial sums: no group of them is gathered.
2. Per part there are at most 32 counts, one for each mask.  From them comes the part's removal polynomial, the
   multilinear extension of "documents removed by the filters of a set S": F(x) is the sum over masks m of
   count(m) * (1 - product of (1 - x_i) for i in m), kept as whole coefficients of its square-free monomials.
3. At a corner, x the indicator of S, F is the number that S removes: survivors, removed, redundant and unique
   failures of every step of every order are differences of corners.
4. The Shapley value of filter i is the integral over t from 0 to 1 of dF/dx_i at (t, ..., t).  It is taken in
   exact rationals; 120 times it is whole, the sum over all orders.

Defined results: a null text is empty, fails A, and equals every other null or empty text.  A null doc_id is no
smaller id of anything and has none itself: its row never fails E.  Rows that repeat an id count each time and do
not make each other fail E.  A null part is ''.  Labels: an id counts as good or toxic if any of its label rows
says so; rows without labels are neither.  An empty table has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, hinted, pieces, ready, written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
MARKS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that continue a code point.
INNER = bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """Bits of A to D."""
    words = text.split()
    points = len(text.translate(None, INNER))
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * upper > UPPER_PERCENT * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def examined(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, digest, mask for each row: whole texts are read once and stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch):
                digests = pa.array([blake2b(t, digest_size=24).digest() for t in texts], pa.binary())
                masks = pa.array([own_failures(t) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), digests, masks], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows by the set of filters that they fail, E included."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).where("quality + toxic > 0")
    # two plans read this; written, whole texts are read once
    ids = written(examined(docs, part).groupBy("digest", "part", "doc_id").agg(F.count("*").alias("n"), F.first("mask").alias("mask")), "rows")
    ids = ids.join(hinted(known), "doc_id", "left").select("digest", "part", "doc_id", "mask", "n", *((F.col("n") * F.coalesce(c, F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    # a part's rows of one text: all of them, and those of its least id, which alone may be free of E
    kinds = ("n", "good", "toxic")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *kinds))
    nameless = [F.sum(F.when(F.col("doc_id").isNull(), F.col(k)).otherwise(0)).alias(f"nameless_{k}") for k in kinds]
    texts = ids.groupBy("digest", "part").agg(F.first("mask").alias("mask"), *(F.sum(k).alias(k) for k in kinds), *nameless, F.min(named).alias("least"))
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    texts = texts.join(hinted(first), "digest", "left").withColumn("first", F.coalesce("first", "least.doc_id"))
    free = {k: F.col(f"nameless_{k}") + F.when(F.col("least.doc_id") == F.col("first"), F.col(f"least.{k}")).otherwise(0) for k in kinds}
    both = F.array(
        F.struct(F.col("mask"), *(free[k].alias(k) for k in kinds)),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(k) - free[k]).alias(k) for k in kinds)),
    )
    rows = texts.select("part", F.explode(both).alias("x")).select("part", "x.*").where("n > 0")
    return rows.groupBy("part", "mask").agg(*(F.sum(k).alias(k) for k in kinds))


class Removal:
    """The multilinear extension of the number of rows that a set of filters removes."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)) -> None:
        self.filters = filters
        #: Coefficient of the monomial of each set of variables.
        self.coefficients = np.zeros(1 << filters, dtype=object)
        for mask, n in counts.items():
            # 1 - product of (1 - x_i): the sum over non-empty subsets of the mask, signs alternating
            part = mask
            while part:
                self.coefficients[part] += n if part.bit_count() % 2 else -n
                part = (part - 1) & mask

    def corner(self, chosen: int) -> int:
        """The value where the chosen variables are 1 and the others 0: rows that these filters remove together."""
        total, part = 0, chosen
        while part:
            total += self.coefficients[part]
            part = (part - 1) & chosen
        return int(total)

    def derivative(self, i: int) -> list[int]:
        """dF/dx_i along the diagonal (t, ..., t), by powers of t."""
        out = [0] * self.filters
        for part, a in enumerate(self.coefficients):
            if part >> i & 1:
                out[part.bit_count() - 1] += int(a)
        return out

    def shapley(self, i: int) -> Fraction:
        return sum((Fraction(a, k + 1) for k, a in enumerate(self.derivative(i))), Fraction(0))


def audited(counts: dict[str, dict[int, int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order; counts: n, good, toxic by mask."""
    removal = {k: Removal(counts[k], len(filters)) for k in ("n", "good", "toxic")}
    every = (1 << len(filters)) - 1
    corner = {k: [f.corner(s) for s in range(every + 1)] for k, f in removal.items()}
    n, whole, orders = sum(counts["n"].values()), corner["n"], factorial(len(filters))
    values = [removal["n"].shapley(i) * orders for i in range(len(filters))]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError("a sum over all orders is whole")
    out = []
    for order in permutations(range(len(filters))):
        before, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = {k: corner[k][after] - corner[k][before] for k in corner}
            out.append((name, step, n - whole[after], lost["n"], whole[1 << i] - lost["n"], whole[every] - whole[every & ~(1 << i)], lost["good"], lost["toxic"], int(values[i])))
            before = after
    return out


COLUMNS = {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    ready(docs.sparkSession)
    entry: Column = F.struct("mask", "n", "good", "toxic")
    parts = mask_counts(docs, labels, part).groupBy("part").agg(F.sort_array(F.collect_list(entry)).alias("masks"))  # at most 32 a part

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, masks in zip(frame["part"], frame["masks"], strict=True):
                counts = {k: {int(m["mask"]): int(m[k]) for m in masks} for k in ("n", "good", "toxic")}
                yield pd.DataFrame([(name, *row) for row in audited(counts)], columns=list(COLUMNS))

    return parts.mapInPandas(run, ", ".join(f"{k} {t}" for k, t in COLUMNS.items()))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
least AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
good AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w JOIN least ON least.text = w.text LEFT JOIN good ON good.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, s.x, n, good, toxic, fails,
  contains(fails, s.x) AS mine, len(fails) > len(translate(fails, earlier, '')) AS gone FROM c, s),
a AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT mine AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN mine AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mine AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mine AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mine AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM a
"""
