"""The corpus pipeline: five stages over documents, each a DataFrame that is written and read again for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontamination, jaccard, language_id, pii, sentencepiece_lattice


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without readable text or a certain language go.  Columns as before."""
    found = language_id.identify(language_id.evidence(docs))
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join one row stays, that of the smallest id (rows without an id come last, equal ids by their place).

    Rows count by themselves: an id may stand for several texts, and a text may repeat under one id or without any.
    """
    name = common.free("row", docs.columns)
    rows = common.numbered(docs, name)
    found = jaccard.classes(rows.select(F.col(name).alias("doc_id"), "text"), with_links=False)
    others = common.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name), "component_id"), "copies")
    members = others.unionByName(others.select(F.col("component_id").alias(name), "component_id").distinct())
    ids = rows.select(name, F.col("doc_id").cast("long").alias("id"))
    members = common.written(ids.join(common.hinted(members), name), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", name))[name].alias("first"))
    losers = common.written(members.join(common.hinted(first), "component_id").where(F.col(name) != F.col("first")).select(name), "losers")
    return rows.join(common.hinted(losers), name, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    common.ready(spark)
    found = decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_units, n_pieces, ids_digest, n_decoded, text_digest, round_trip, ids, text: encoded and decoded again."""
    return sentencepiece_lattice.encode(docs, public_tokenizers.path(sentencepiece_lattice.MODEL), whole=True).drop("row")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: Models and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
