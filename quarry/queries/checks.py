"""Queries over corpus checks, evidence and review rules: each applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import evidence as E
from quarry.operators import quality as Q
from quarry.queries.corpus import DENSE, dense_hits
from quarry.queries.corpus import sql as with_ctes
from quarry.queries.registry import query
from quarry.sources.tables import raw
from quarry.streaming import events as S

PAGE_LINES = 20
LINES = f"l AS (SELECT doc_id, pos // {PAGE_LINES} AS page, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS f, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS b FROM l)"


@query("furniture_lines", with_ctes("SELECT document_id, text, pages FROM (SELECT doc_id AS document_id, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS text, count(DISTINCT page) AS pages FROM e WHERE f = 1 OR b = 1 GROUP BY 1, 2) WHERE text <> '' AND (pages >= 2 OR regexp_matches(text, '(?i)confidential|internal use only|page #'))", LINES))
def furniture_lines(spark, sf):
    """Texts in pages of twenty lines: what stands first or last on more than one of them."""
    lines = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return Q.furniture(lines.withColumn("page", F.floor(F.col("line_no") / PAGE_LINES)))


@query("document_evidence", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'LOW' WHEN source IN ('src0', 'src1') THEN 'HIGH' WHEN source IN ('src2', 'src3') THEN 'MEDIUM' ELSE 'LOW' END AS reliability, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN DATE '1997-01-01' + CAST(doc_id % 300 AS INTEGER) END AS effective_from, sha256(text) AS hash, least(length(text), 1200) AS quoted FROM documents")
def document_evidence(spark, sf):
    k = F.col("doc_id")
    kind = F.coalesce(*(F.when(F.col("source") == s, t) for s, t in (("src0", "METRIC"), ("src1", "POLICY"), ("src2", "REPORT"), ("src3", "PRODUCT"))), F.lit("OTHER"))
    start = F.when(k % 7 != 0, F.date_add(F.lit("1997-01-01").cast("date"), (k % 300).cast("int")))
    end = F.when(k % 5 != 0, F.lit("1999-01-01").cast("date"))
    hits = raw(spark, sf, "documents").select(k.alias("chunk_id"), kind.alias("document_type"), F.when(k % 3 == 0, "EXTERNAL").otherwise("INTERNAL").alias("source_kind"), start.alias("effective_from"), end.alias("effective_to"), "text")
    return E.document_evidence(hits).select(F.col("chunk_id").alias("doc_id"), "reliability", F.col("effective.effective_from").alias("effective_from"), "hash", F.length("quote").cast("long").alias("quoted"))


@query("unpaired_documents", "SELECT o_orderkey AS logical_key FROM orders d WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = d.o_orderkey + 1 AND (p.o_orderstatus = 'F') <> (d.o_orderstatus = 'F'))")
def unpaired_documents(spark, sf):
    k = F.col("o_orderkey")
    docs = raw(spark, sf, "orders").select(k.alias("logical_key"), F.when(k % 2 == 0, k + 1).alias("pair_with"), F.when(F.col("o_orderstatus") == "F", "EXTERNAL").otherwise("INTERNAL").alias("source_kind"))
    return Q.unpaired(docs).select("logical_key")


@query("failed_scans", "SELECT o_orderkey AS document_id, n_chunks FROM (SELECT o_orderkey, o_orderkey % 4 <> 0 AS layer, o_orderkey % 3 = 0 AS failed, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_chunks FROM orders) WHERE (NOT layer AND NOT failed) OR (failed AND n_chunks > 0)")
def failed_scans(spark, sf):
    k = F.col("o_orderkey")
    docs = raw(spark, sf, "orders").select(k.alias("document_id"), (k % 4 != 0).alias("has_text_layer"), F.when(k % 3 == 0, "FAILED").otherwise("READY").alias("status"))
    chunks = raw(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"))
    return Q.chunks_of_failed(docs, chunks).select("document_id", "n_chunks")


@query("version_mismatches", "SELECT l_orderkey AS order_key, l_linenumber AS line, l_linestatus AS version, o_orderstatus AS expected_version FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus <> o_orderstatus")
def version_mismatches(spark, sf):
    left = raw(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("version"))
    right = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("expected_version"))
    return Q.mismatched_versions(left, right, "order_key").select("order_key", "line", "version", "expected_version")


@query("self_retrieval", with_ctes("SELECT vec_id FROM embeddings s WHERE vec_id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.query_id = s.vec_id AND dr.vec_id = s.vec_id AND rank <= 1)", DENSE))
def self_retrieval(spark, sf):
    """Vectors that are not the first hit of a search for themselves: equal ones of a smaller id come before them."""
    hits = dense_hits(spark, sf).where("rank <= 1").select("query_id", F.col("vec_id").alias("key"))
    return Q.self_retrieval(raw(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("chunk_id")), hits).select(F.col("chunk_id").alias("vec_id"))


@query("answered_absent", "SELECT c_custkey AS query_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def answered_absent(spark, sf):
    c = raw(spark, sf, "customer")
    outcomes = c.select(F.col("c_custkey").alias("query_id"), (F.col("c_acctbal") < 0).alias("refused"))
    return Q.answered_absent(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("query_id")), outcomes)


@query("node_durations", "SELECT o_orderpriority AS node, o_orderstatus AS outcome, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice) AS p95 FROM orders GROUP BY 1, 2")
def node_durations(spark, sf):
    return S.durations(raw(spark, sf, "orders").select(F.col("o_orderpriority").alias("node"), F.col("o_orderstatus").alias("outcome"), F.col("o_totalprice").alias("millis")))


@query("clipped_texts", "SELECT doc_id, sha256(t) AS hash, len(list_filter(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: NOT list_contains(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?'), x))) = 0 AS keeps FROM (SELECT doc_id, text, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS t FROM documents)")
def clipped_texts(spark, sf):
    t = X.clip(F.col("text"), 80)
    return raw(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("hash"), X.keeps_numbers(F.col("text"), t).alias("keeps"))
