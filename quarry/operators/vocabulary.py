"""Frozen vocabulary: document frequency, ids, inverse frequency, sparse weights and search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.sources.shared import bounded, settled

#: Texts whose words are counted at once.
COUNTED = 256


def postings(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """key, token, c: occurrences.  Counting is partial before the shuffle, as a text's words lie in one task."""
    return docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))


def counted_words(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """key, token, c, most: each text's different words with their counts, and its greatest count.

    A text is counted where it stands and nothing is shuffled; only texts that share an id are counted by joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time: words as Python strings take many times their bytes
        for batch in (b.slice(i, COUNTED) for b in batches for i in range(0, b.num_rows, COUNTED)):
            ids, tokens, counts, most = [], [], [], []
            for k, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = Counter(some or ())
                ids += [k] * len(n)
                tokens += n.keys()
                counts += n.values()
                most += [max(n.values(), default=0)] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64()), pa.array(most, pa.int64())], names=[key, "token", "c", "most"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias(key), words)
    again = rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("again"))
    schema = f"{key} long, token string, c long, most long"
    if not again.limit(1).count():
        return rows.mapInArrow(run, schema)
    again, same = settled(again), F.col(key).eqNullSafe(F.col("again"))
    several = postings(rows.join(again, same, "left_semi"), key, words)
    most = several.groupBy(F.col(key).alias("again")).agg(F.max("c").alias("most"))
    return rows.join(again, same, "left_anti").mapInArrow(run, schema).unionByName(several.join(most, same).select(key, "token", "c", "most"))


def document_frequency(docs: DataFrame, words: str = "words") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def with_ids(frequency: DataFrame, known: DataFrame | None = None, *, limit: int = 1 << 24) -> DataFrame:
    """token, df, token_id.  Known tokens keep their rows; new ones get ids after the highest, by (-df, token).

    A range sort spreads the new tokens over partitions; each numbers its own rows after the sizes of
    those before it, so no task holds the whole vocabulary.
    """
    spark = frequency.sparkSession
    fresh = frequency.join(known.select("token"), "token", "left_anti") if known is not None else frequency
    first = (known.agg(F.max("token_id")).first()[0] + 1) if known is not None and known.limit(1).count() else 0
    ranges = 1 + int(fresh.count() // 1_000_000)
    if ranges == 1:
        numbered = fresh.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("df"), "token")) + F.lit(first - 1))
    else:
        sorted_ = settled(fresh.repartitionByRange(ranges, F.desc("df"), "token").withColumn("_p", F.spark_partition_id()))
        own = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("df"), "token"))
        sizes = sorted_.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = sorted_.withColumn("_r", own).join(F.broadcast(sizes.select("_p", "_b")), "_p").withColumn("token_id", F.col("_r") + F.col("_b") + F.lit(first - 1)).drop("_p", "_r", "_b")
    numbered = numbered.select("token", "df", F.col("token_id").cast("long").alias("token_id"))
    out = known.select("token", "df", "token_id").unionByName(numbered) if known is not None else numbered
    del spark
    return out.withColumn("token_id", F.when(F.col("token_id") < limit, F.col("token_id")).otherwise(F.raise_error(F.lit("token id beyond the sparse dimension"))))


def with_idf(vocabulary: DataFrame, n_docs: int) -> DataFrame:
    return vocabulary.withColumn("idf", X.inverse_frequency(F.col("df"), F.lit(n_docs)))


def sparse_weights(counted: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, token_id, w for tokens of the vocabulary; the greatest count is over all tokens of a text."""
    most = counted if "most" in counted.columns else counted.withColumn("most", F.max("c").over(Window.partitionBy(key)))
    return most.join(vocabulary.select("token", "token_id", "idf"), "token").select(key, "token_id", X.term_weight(F.col("c"), F.col("most"), F.col("idf")).alias("w"))


def sparse_scores(queries: DataFrame, documents: DataFrame, query: str, key: str) -> DataFrame:
    """Positive dot products over shared token ids."""
    q = queries.select(query, "token_id", F.col("w").alias("q"))
    return q.join(documents, "token_id").groupBy(query, key).agg(F.round(F.sum(F.col("q") * F.col("w")), 6).alias("score")).where("score > 0")


def top(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best of each query, ties by key.  Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """token: the lines of a list of stop words, trimmed; none if there is no such file, as the weights keep frequent words down anyway."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "token string")
    return lines.select(F.trim("value").alias("token")).where("token <> ''").distinct()


def without_stop_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    return tokens.join(stop, "token", "left_anti")
