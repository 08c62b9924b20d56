"""Corpus checks and evaluation measures.  A check returns the offending rows; none is a pass."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.retrieval import effective


def furniture(lines: DataFrame, marks: str = r"(?i)confidential|internal use only|page #") -> DataFrame:
    """document_id, text: first or last lines of pages, digits as #, that repeat on two pages or hold a mark."""
    w = Window.partitionBy("document_id", "page")
    edge = lines.withColumns({"_f": F.row_number().over(w.orderBy("line_no")), "_l": F.row_number().over(w.orderBy(F.desc("line_no")))}).where("_f = 1 or _l = 1")
    folded = edge.select("document_id", "page", F.regexp_replace(F.trim("text"), "[0-9]+", "#").alias("text")).where("text <> ''")
    return folded.groupBy("document_id", "text").agg(F.countDistinct("page").alias("pages")).where((F.col("pages") >= 2) | F.col("text").rlike(marks))


def without_furniture(lines: DataFrame, found: DataFrame) -> DataFrame:
    folded = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    return lines.withColumn("_t", folded).join(found.select("document_id", F.col("text").alias("_t")), ["document_id", "_t"], "left_anti").drop("_t")


def repeated_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, line, n: lines that a text holds least times or more."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mismatched_versions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key).where("version <> expected_version")


PROVINCES = r"(?:覆盖|covers)\s*([0-9]+)\s*(?:个省|provinces|nations)"


def scope_mismatches(texts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Texts that claim another number of provinces for their region than the dimension has."""
    claimed = texts.withColumn("claimed", F.explode(F.transform(F.regexp_extract_all("text", F.lit(PROVINCES), F.lit(1)), lambda x: x.cast("long"))))
    return claimed.join(dimension.select("region_name", "province_count"), "region_name").where(F.col("claimed") != F.col("province_count")).drop("text")


def chunks_of_failed(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a text layer that did not fail, or failed ones that have chunks all the same."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    joined = documents.join(n, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return joined.where((~F.col("has_text_layer") & (F.col("status") != "FAILED")) | ((F.col("status") == "FAILED") & (F.col("n_chunks") > 0)))


def unpaired(documents: DataFrame) -> DataFrame:
    """Internal documents that name an external partner which is not there, and the other way round."""
    d, p = documents.alias("d"), documents.alias("p")
    pair = (F.col("d.pair_with") == F.col("p.logical_key")) & (F.col("d.source_kind") != F.col("p.source_kind"))
    return d.where(F.col("d.pair_with").isNotNull()).join(p, pair, "left_anti")


def answered_absent(questions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Questions on topics the corpus lacks that were not refused."""
    return questions.join(outcomes.where(~F.col("refused")), "query_id", "left_semi")


def self_retrieval(sample: DataFrame, hits: DataFrame) -> DataFrame:
    """Sampled chunks that a search for themselves does not bring back."""
    return sample.join(hits.select(F.col("query_id").alias("chunk_id"), "key").where("chunk_id = key"), "chunk_id", "left_anti")


def recall_at(expected: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of expected keys among the first k."""
    found = expected.join(hits.where(F.col("rank") <= k).select("query_id", "key").distinct().withColumn("_hit", F.lit(1)), ["query_id", "key"], "left")
    return found.groupBy("query_id").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"), F.count("*").alias("expected"))


def cell(value: object) -> str:
    """A result's cell as it is compared: numbers at two decimals, None as NULL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    try:
        return str(Decimal(str(value)).quantize(Decimal("0.01")))
    except (InvalidOperation, ValueError):
        return str(value)


def rows_equal(got: list, wanted: list, *, ordered: bool = False, subset: bool = False) -> bool:
    """Same rows (in order, if asked); with subset each wanted row is a subsequence of a row of its own among those got."""
    a, b = ([tuple(map(cell, r)) for r in rows] for rows in (got, wanted))
    if not ordered:
        a, b = sorted(a), sorted(b)
    if not subset:
        return a == b

    def inside(short: tuple, long: tuple) -> bool:
        rest = iter(long)
        return all(x in rest for x in short)

    for row in b:
        at = next((i for i, x in enumerate(a) if inside(row, x)), None)
        if at is None:
            return False
        del a[at]
    return True


def without_note(documents: DataFrame, chunks: DataFrame, note: str) -> DataFrame:
    """Documents none of whose chunks holds the note that tells on which basis their figures stand."""
    return documents.join(chunks.where(F.col("text").contains(note)).select("document_id"), "document_id", "left_anti")


def wrong_versions(documents: DataFrame) -> DataFrame:
    """logical_key, day, problem: of keys with several versions, on the day the newest begins, an old one that is still in force or a new one that is not.

    NO_END where the oldest version has no last day: such a pair tells nothing about the filter.
    """
    version = F.struct("version", "effective_from", "effective_to")
    pairs = documents.groupBy("logical_key").agg(F.min(version).alias("old"), F.max(version).alias("new"), F.countDistinct("version").alias("n")).where("n > 1")
    day = F.col("new.effective_from")
    old_found, new_found = (effective(F.col(f"{x}.effective_from"), F.col(f"{x}.effective_to"), day) for x in ("old", "new"))
    problem = F.when(F.col("old.effective_to").isNull(), "NO_END").when(old_found, "OLD_FOUND").when(~new_found, "NEW_MISSING")
    return pairs.select("logical_key", day.alias("day"), problem.alias("problem")).where("problem is not null")


def divided_terms(terms: DataFrame, words: Column) -> DataFrame:
    """Terms of a dictionary that the given segmentation does not give back as one word."""
    return terms.where(~((F.size(words) == 1) & (words[0] == F.lower("term"))))
