"""Evidence and disagreements between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import numbers, periods

FEW_ROWS, SHOWN, CLAIM_COLUMNS = 20, 3, 12
#: Reliability of a document's kind.
RELIABILITY = {"METRIC": "HIGH", "POLICY": "HIGH", "REPORT": "MEDIUM", "PRODUCT": "MEDIUM", "OTHER": "LOW"}


def header_metric(headers: DataFrame, lexicon: DataFrame) -> DataFrame:
    """headers' columns with metric, exact and unit: a header's name, without its unit in brackets, is a metric's exact name or an alias of it.

    lexicon: name, metric, exact; its equality join needs no bound on either side.
    """
    bracket = r"[(（]([^()（）]+)[)）]\s*$"
    named = headers.withColumns({"unit": F.nullif(F.regexp_extract("header", bracket, 1), F.lit("")), "name": F.lower(F.trim(F.regexp_replace("header", bracket, "")))})
    return named.join(lexicon.select(F.lower("name").alias("name"), "metric", "exact"), "name").drop("name")


def claim(columns: list[str]) -> Column:
    """col=value; ... of the first columns."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in columns[:CLAIM_COLUMNS]]
    return F.concat_ws("；", *parts)


def content_hash(fingerprint: str, columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(fingerprint), F.lit(",".join(columns)), *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns)), 256)


def has_no_values(df: DataFrame) -> bool:
    """No rows, or only rows of nulls."""
    present = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(1)) for c in df.columns))
    return df.where(present.isNotNull()).limit(1).count() == 0


def sql_evidence(result: DataFrame, fingerprint: str, order: list[str], few: int = FEW_ROWS) -> DataFrame:
    """ordinal, claim, hash: one piece for each row up to few, one summary beyond, none for an empty result.

    result is bounded by the governed execution's row limit.
    """
    columns = result.columns
    n = result.count()
    if not n or has_no_values(result):
        return result.sparkSession.createDataFrame([], "ordinal int, claim string, hash string")
    w = Window.orderBy(*order)  # at most the row limit
    rows = result.withColumn("ordinal", F.row_number().over(w)).select("ordinal", claim(columns).alias("claim"), content_hash(fingerprint, columns).alias("hash"))
    if n <= few:
        return rows
    first = rows.where(F.col("ordinal") <= SHOWN)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "claim"))), lambda x: x["claim"]), " | ")
    summary = first.agg(F.concat(F.lit(f"{n} rows: "), text).alias("claim"))
    return summary.select(F.lit(1).alias("ordinal"), "claim", F.sha2("claim", 256).alias("hash"))


def document_evidence(hits: DataFrame) -> DataFrame:
    """Reliability by document type (LOW from outside), an effective range only if both ends are known, the text's hash."""
    level = F.lit("LOW")
    for kind, value in RELIABILITY.items():
        level = F.when(F.col("document_type") == kind, value).otherwise(level)
    both = F.col("effective_from").isNotNull() & F.col("effective_to").isNotNull()
    return hits.select("chunk_id", F.when(F.col("source_kind") == "EXTERNAL", "LOW").otherwise(level).alias("reliability"), F.when(both, F.struct("effective_from", "effective_to")).alias("effective"), F.sha2("text", 256).alias("hash"), F.substring("text", 1, 1200).alias("quote"))


def comparable(left: Column, right: Column) -> Column:
    """Scopes (maps) compare if one is empty, or if they agree on every dimension that both name and name the same ones."""
    size = lambda m: F.coalesce(F.size(m), F.lit(0))
    keys = F.array_sort(F.map_keys(left))
    same = F.forall(keys, lambda k: F.element_at(left, k).eqNullSafe(F.element_at(right, k)))
    return (size(left) <= 0) | (size(right) <= 0) | ((F.array_sort(F.map_keys(right)) == keys) & same)


def exact_headers(claims: DataFrame) -> DataFrame:
    """Where a table has a metric under its exact name, its aliases there are left out; rows over one dimension too."""
    w = Window.partitionBy("table_id", "metric")
    best = claims.where(F.size("dims") <= 1).withColumn("_exact", F.max(F.col("exact").cast("int")).over(w))
    return best.where((F.col("_exact") == 0) | F.col("exact")).drop("_exact")


def in_base_units(value: Column, unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, f in numbers.UNITS.items():
        factor = F.when(unit == name, F.lit(float(f))).otherwise(factor)
    return F.round(value * factor, 4)


def too_early(cutoff: Column, period: Column) -> Column:
    """A report's cutoff lies before its period's last day."""
    return cutoff.isNotNull() & (cutoff < F.date_sub(periods.end_column(period), 1))


def met(rows: DataFrame, *, left: bool) -> DataFrame:
    """rows with _period and _scope, join keys of which exactly one is shared by two rows that may be compared.

    A known value is "=value" on both sides.  The left side's unknown is "<", which every right row
    carries too; the right side's unknown is ">", which every known left row carries too.  So the
    wildcards are an equality join, of at most four rows a row, and no pair comes twice.
    """
    own, other = ("<", ">") if left else (">", "<")

    def keys(known: Column) -> Column:
        if left:
            return F.when(known.isNull(), F.array(F.lit(own))).otherwise(F.array(F.concat(F.lit("="), known), F.lit(other)))
        return F.array(F.coalesce(F.concat(F.lit("="), known), F.lit(own)), F.lit(other))

    named = F.when(F.size("scope") > 0, F.to_json(F.array_sort(F.map_entries("scope"))))
    return rows.withColumn("_period", F.explode(keys(F.upper("period")))).withColumn("_scope", F.explode(keys(named)))


def conflicts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """kind, claim_id, fact_id, metric, delta.

    Claims and facts meet on metric, period and scope, an unknown period or an empty scope passes on
    either side.  A claim whose cutoff is too early is a TIME conflict, once for each document (its
    logical_key where the claims have one, else its evidence), period and cutoff, and no VALUE conflict
    besides; a VALUE conflict exceeds the tolerance.
    """
    document = F.coalesce("logical_key", "evidence_id") if "logical_key" in claims.columns else F.col("evidence_id")
    c = met(claims.withColumn("_document", document), left=True).alias("c")
    pairs = c.join(met(facts, left=False).alias("f"), ["metric", "_period", "_scope"])
    base = F.col("f.value")
    value = in_base_units(F.col("c.value"), F.col("c.unit"))
    early = too_early(F.col("c.cutoff"), F.coalesce("c.period", "f.period"))
    rows = pairs.select(F.when(early, "TIME").when(F.abs(value - base) > numbers.tolerance(base), "VALUE").alias("kind"), F.col("c.claim_id"), F.col("f.fact_id"), F.col("metric"), F.round(value - base, 4).alias("delta"), F.col("c._document"), F.upper("c.period").alias("_claimed"), F.col("c.cutoff").alias("_cutoff"))
    rows = rows.where("kind is not null")
    w = Window.partitionBy("_document", "_claimed", "_cutoff").orderBy("claim_id", "fact_id")
    time = rows.where("kind = 'TIME'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.where("kind = 'VALUE'").unionByName(time).drop("_document", "_claimed", "_cutoff")


def definition_conflicts(documents: DataFrame, metrics: DataFrame) -> DataFrame:
    """logical_key, metric, document_version, metric_version where both versions are known and differ; each once."""
    rows = documents.join(metrics, "metric").where(F.col("document_version").isNotNull() & F.col("metric_version").isNotNull() & (F.col("document_version") != F.col("metric_version")))
    return rows.select("logical_key", "metric", "document_version", "metric_version").dropDuplicates(["logical_key", "metric", "document_version"])
