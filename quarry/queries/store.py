"""Queries over the store of chunks: payloads, counts, reloads, reports, versions, citations, idle streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import segments as G
from quarry.functions import text as X
from quarry.operators import quality as Q
from quarry.operators import retrieval as R
from quarry.operators import review as V
from quarry.queries.corpus import META, metadata
from quarry.queries.corpus import sql as with_ctes
from quarry.queries.registry import query
from quarry.queries.trails import TABLE, table_rows
from quarry.sources import sinks
from quarry.sources.shared import folder
from quarry.sources.tables import raw
from quarry.sources.versions import Table
from quarry.streaming import events as S
from quarry.streaming.handover import followed


def new_path(spark, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("payload_validity", "SELECT doc_id, sha256(text) AS checksum, CAST(doc_id % 4 AS VARCHAR) AS version FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND text IS NOT NULL")
def payload_validity(spark, sf):
    """Payloads without a checksum or a version, and those cut off in writing, are left out whole."""
    k = F.col("doc_id")
    whole = F.to_json(F.struct(F.when(k % 7 != 0, F.sha2("text", 256)).alias("checksum"), F.when(k % 5 != 0, (k % 4).cast("string")).alias("version")))
    points = raw(spark, sf, "documents").select(k, F.when(k % 11 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("payload"))
    return R.valid_payloads(points, ("checksum", "version"))


@query("point_counts", with_ctes("SELECT count(CASE WHEN lang = 'en' AND source IN ('src0', 'src3') AND (effective_from IS NULL OR effective_from <= DATE '1997-08-01') AND (effective_to IS NULL OR DATE '1997-08-01' <= effective_to) THEN 1 END) AS n, count(*) AS n_all FROM m", META))
def point_counts(spark, sf):
    return R.counted(metadata(spark, sf), roles=("ANALYST",), day=date(1997, 8, 1), departments=("src0", "src3"))


@query("chunk_scroll", "SELECT vec_id, label FROM embeddings")
def chunk_scroll(spark, sf):
    return R.scrolled(raw(spark, sf, "embeddings"))


@query("versioned_reload", "SELECT CAST(n AS INTEGER) AS version, o_orderkey, o_orderstatus FROM orders, (SELECT unnest([0, 1, 2]) AS n) WHERE (n = 0 AND o_orderstatus = 'F') OR (n = 1 AND o_orderstatus <> 'F') OR (n = 2 AND o_orderstatus <> 'F' AND o_orderkey % 3 = 0)")
def versioned_reload(spark, sf):
    """A table of orders reloaded twice, the second time from itself; every version is read back."""
    t = Table(spark, new_path(spark, "orders"))
    o = raw(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    t.replace(o.where("o_orderstatus = 'F'"))
    t.replace(o.where("o_orderstatus <> 'F'"))
    t.replace(t.read().where("o_orderkey % 3 = 0"))
    out = None
    for n in t.numbers():
        rows = t.read(n).select(F.lit(n).cast("int").alias("version"), "o_orderkey", "o_orderstatus")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("bounded_log", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1500")
def bounded_log(spark, sf):
    """All events in four parts of a log, cut back to the newest 1500."""
    e = raw(spark, sf, "events").select("event_id", "user_id")
    top = e.agg(F.max("event_id")).first()[0]
    t = Table(spark, new_path(spark, "log"))
    for k in range(4):
        t.append(e.where((F.col("event_id") > top * k // 4 - (k == 0)) & (F.col("event_id") <= top * (k + 1) // 4)), "event_id")
    t.trimmed(1500)
    t.retain(1)
    return t.read()


@query("replay_then_live", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100")
def replay_then_live(spark, sf):
    """The events reach a log in two halves; the first is replayed after a cursor, the second comes through the stream, which is started twice."""
    e = raw(spark, sf, "events").select("event_id", "user_id", "event_type")
    half = e.agg(F.max("event_id")).first()[0] // 2
    path, sink, state = (new_path(spark, n) for n in ("log", "sink", "state"))
    e.where(F.col("event_id") <= half).write.parquet(path)
    followed(spark, path, sink, state, after=100, per_trigger=100)
    e.where(F.col("event_id") > half).write.mode("append").parquet(path)
    return followed(spark, path, sink, state, after=100, per_trigger=100)


@query("full_reload", "SELECT c_custkey, c_mktsegment FROM customer")
def full_reload(spark, sf):
    """A table that held other rows is replaced by all customers."""
    customers, path = raw(spark, sf, "customer").select("c_custkey", "c_mktsegment"), new_path(spark, "reloaded")
    sinks.reloaded(customers.select((-F.col("c_custkey")).alias("c_custkey"), F.lit("OLD").alias("c_mktsegment")), path)
    return sinks.reloaded(customers, path)


REPORTS = "n AS (SELECT l_orderkey, count(*) AS chunks, count(CASE WHEN l_quantity < 5 THEN 1 END) AS empty, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS published FROM lineitem GROUP BY 1)"


@query("ingestion_reports", with_ctes("SELECT o_orderkey AS document_id, o_orderstatus AS status, coalesce(chunks, 0) AS chunk_count, coalesce(empty, 0) AS empty_sparse_chunks, coalesce(published, 0) AS published_count, o_orderkey % 6 <> 0 AS ok, o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 AS unsupported, CASE WHEN o_orderkey % 6 = 0 THEN 'no text' END AS error_summary FROM orders LEFT JOIN n ON l_orderkey = o_orderkey", REPORTS))
def ingestion_reports(spark, sf):
    """Order lines stand for chunks, a small quantity for one without a sparse vector; written as JSON and read back."""
    k = F.col("o_orderkey")
    docs = raw(spark, sf, "orders").select(k.alias("document_id"), F.col("o_orderstatus").alias("status"), (k % 4 != 0).alias("has_text_layer"), F.when(k % 6 == 0, "no text").alias("error_summary"))
    chunks = raw(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_quantity") < 5, 0).otherwise(1).alias("n_terms"), F.when(F.col("l_linestatus") == "F", "ACTIVE").otherwise("PROCESSING").alias("status"))
    return sinks.write_reports(sinks.ingestion_reports(docs, chunks), new_path(spark, "reports"))


@query("basis_notes", "SELECT doc_id AS document_id FROM documents WHERE source = 'src1' AND NOT coalesce(contains(text, 'the data'), false)")
def basis_notes(spark, sf):
    """Documents of one source of which no line holds the words that stand for the note."""
    docs = raw(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("text"))
    return Q.without_note(docs.where("source = 'src1'").select(F.col("doc_id").alias("document_id")), lines, "the data")


VERSIONS = "d AS (SELECT o_custkey AS logical_key, o_orderkey AS version, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 200 END AS b FROM orders), p AS (SELECT logical_key, arg_min(a, version) AS old_from, arg_min({'x': b}, version).x AS old_to, arg_max(a, version) AS day, arg_max({'x': b}, version).x AS new_to FROM d GROUP BY 1 HAVING count(DISTINCT version) > 1)"


@query("version_pairs", with_ctes("SELECT logical_key, day, problem FROM (SELECT *, CASE WHEN old_to IS NULL THEN 'NO_END' WHEN old_from <= day AND day <= old_to THEN 'OLD_FOUND' WHEN new_to IS NOT NULL AND day > new_to THEN 'NEW_MISSING' END AS problem FROM p) WHERE problem IS NOT NULL", VERSIONS))
def version_pairs(spark, sf):
    """A customer's orders stand for the versions of one document."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    return Q.wrong_versions(raw(spark, sf, "orders").select(F.col("o_custkey").alias("logical_key"), k.alias("version"), start.alias("effective_from"), F.when(k % 3 != 0, F.date_add(start, 200)).alias("effective_to")))


@query("dictionary_round_trip", "SELECT term FROM (SELECT DISTINCT n_name AS term FROM nation UNION SELECT r_name FROM region UNION SELECT p_type FROM part) WHERE regexp_extract_all(lower(term), '[\\p{L}\\p{N}]+') <> [lower(term)]")
def dictionary_round_trip(spark, sf):
    terms = raw(spark, sf, "nation").select(F.col("n_name").alias("term")).union(raw(spark, sf, "region").select("r_name")).union(raw(spark, sf, "part").select("p_type")).distinct()
    return Q.divided_terms(terms, X.letter_words(F.col("term")))


TYPES = "w AS (SELECT word, CAST(count(*) AS DOUBLE) AS freq FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part) WHERE word <> '' GROUP BY 1), c AS (SELECT word, round(ln(freq / (SELECT sum(freq) FROM w)), 9) AS cost FROM w)"


def type_words(spark, sf):
    """word, freq: of the parts' types and names; a part's name and type without spaces are the runs."""
    p = raw(spark, sf, "part")
    words = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).unionAll(p.select(F.explode(F.split(F.lower("p_name"), " "))))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("freq")), p.select(F.replace(F.lower(F.concat("p_name", "p_type")), F.lit(" "), F.lit("")).alias("run")).distinct()


@query("segmented_terms", "WITH RECURSIVE " + TYPES + ", r AS (SELECT DISTINCT replace(lower(p_name || p_type), ' ', '') AS run FROM part), p(run, pos, total, words) AS (SELECT run, 0, CAST(0 AS DOUBLE), '' FROM r UNION ALL SELECT run, pos + length(word), round(total + cost, 9), words || CASE WHEN pos = 0 THEN '' ELSE ' ' END || word FROM p JOIN c ON substr(run, pos + 1, length(word)) = word WHERE pos < length(run)) SELECT run, words FROM p WHERE pos = length(run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY total DESC) = 1")
def segmented_terms(spark, sf):
    """Names and types written without spaces, cut again along the best path through the word graph, by joins."""
    words, runs = type_words(spark, sf)
    return G.graph_best(runs, words).select("run", F.array_join("words", " ").alias("words"))


@query("term_round_trip", "SELECT DISTINCT replace(lower(p_name || p_type), ' ', '') AS term, CAST(len(string_split(p_name || ' ' || p_type, ' ')) AS INTEGER) AS general, 1 AS own, 3 AS between FROM part")
def term_round_trip(spark, sf):
    """How many words a term is without being a user term, as one, and with a word before and behind it."""
    words, runs = type_words(spark, sf)
    terms = runs.select(F.row_number().over(Window.orderBy("run")).alias("id"), F.col("run").alias("term"))  # the types are few
    around = terms.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("small"), "term", F.lit("bolt")).alias("text"))
    texts = terms.select("id", F.col("term").alias("text"))
    count = lambda found, name: found.select("id", F.size("words").alias(name))
    plain, own = G.gathered(words), G.gathered(words, terms)
    out = terms.join(count(G.segmented(texts, plain, key="id", runs=G.LETTERS), "general"), "id").join(count(G.segmented(texts, own, key="id", runs=G.LETTERS), "own"), "id")
    between = count(G.segmented(around, own, key="id", runs=G.LETTERS), "between").withColumn("id", F.col("id") - 1_000_000)
    return out.join(between, "id").select("term", "general", "own", "between")


@query("embedding_batches", "SELECT doc_id, CAST(coalesce(length(text), 0) AS DOUBLE) AS first, 2 AS dim FROM documents")
def embedding_batches(spark, sf):
    """A stand-in model whose vectors tell their text's length; batches of 16."""
    out = R.embedded(raw(spark, sf, "documents"), lambda texts: [[float(len(t)), 1.0] for t in texts], key="doc_id")
    return out.select("doc_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("dim"))


# evidence of a task: lines of orders; F orders are documents with tables, O orders results of queries, the others other sources
EVIDENCE = TABLE + ", ev AS (SELECT document_id % 40 AS task_id, document_id * 10 + char_start AS ordinal, CASE caption WHEN 'F' THEN '《Order ' || document_id % 97 || '》（' || section || '）' || CASE WHEN document_id % 2 = 0 THEN '，第 3 页' ELSE '' END WHEN 'O' THEN '业务数据库查询 ' || substr(sha256(CAST(document_id % 97 AS VARCHAR)), 1, 12) ELSE 'Order ' || document_id % 97 END AS source, CASE WHEN caption = 'F' THEN char_start END AS r, CASE WHEN caption = 'O' THEN char_start END AS s, section FROM rows)"
RUNS = "runs AS (SELECT task_id, source, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, '、' ORDER BY a) AS t FROM (SELECT task_id, source, min(v) AS a, max(v) AS b FROM (SELECT task_id, source, v, v - row_number() OVER (PARTITION BY task_id, source ORDER BY v) AS g FROM (SELECT DISTINCT task_id, source, coalesce(r, s) AS v FROM ev WHERE coalesce(r, s) IS NOT NULL)) GROUP BY task_id, source, g) GROUP BY 1, 2), g AS (SELECT task_id, source, min(ordinal) AS first, count(*) AS n, count(r) AS rs, count(s) AS ss, arg_min(section, ordinal) AS section FROM ev GROUP BY 1, 2)"


@query("merged_citations", with_ctes("SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY first, source) AS place, source || CASE WHEN rs > 0 THEN '（表「' || section || '」第 ' || t || ' 行）' WHEN ss > 0 THEN '（结果第 ' || t || ' 行）' WHEN n > 1 THEN '（' || n || ' 条）' ELSE '' END AS text FROM g LEFT JOIN runs USING (task_id, source)", EVIDENCE, RUNS))
def merged_citations(spark, sf):
    order, kind = F.col("document_id"), F.col("caption")
    name = (order % 97).cast("string")
    rows = table_rows(spark, sf).select(
        (order % 40).alias("task_id"),
        (order * 10 + F.col("char_start")).alias("ordinal"),
        F.when(kind == "F", "DOCUMENT").when(kind == "O", "SQL").otherwise("OTHER").alias("source_type"),
        F.concat(F.lit("Order "), name).alias("title"),
        F.col("section"),
        F.when(order % 2 == 0, 3).alias("page_no"),
        F.sha2(name, 256).alias("fingerprint"),
        F.col("section").alias("caption"),
        F.when(kind == "F", F.col("char_start")).alias("row_no"),
        F.when(kind == "O", F.col("char_start") - 1).alias("slice_no"),
    )
    return V.merged_citations(rows)


LIMITS = "c AS (SELECT document_id % 40 AS task_id, document_id, section, caption, count(DISTINCT row_no) AS covered, max(n_rows) AS total FROM pos WHERE l_returnflag = 'R' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT row_no) < max(n_rows)), k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CAST(document_id AS VARCHAR), caption, total, covered, document_id, section) AS place, count(*) OVER (PARTITION BY task_id) AS n FROM c)"


@query("table_limits", with_ctes("SELECT task_id, place, CASE WHEN place <= 3 THEN '表格「' || caption || '」（' || document_id || '）共 ' || total || ' 行，已引用 ' || covered || ' 行' ELSE '另有 ' || n - 3 || ' 张表不完整' END AS text FROM k WHERE place <= 4", TABLE, LIMITS))
def table_limits(spark, sf):
    cited = R.table_positions(table_rows(spark, sf)).where("l_returnflag = 'R'")
    return V.table_limits(cited.withColumns({"task_id": F.col("document_id") % 40, "document": F.col("document_id").cast("string")}))


@query("idle_frames", "SELECT user_id, ts + to_microseconds(k * 21600000000) AS at FROM (SELECT user_id, ts, unnest(range(1, n + 1)) AS k FROM (SELECT user_id, ts, (epoch_us(next) - epoch_us(ts) - 1) // 21600000000 AS n FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)) WHERE n >= 1)")
def idle_frames(spark, sf):
    """A frame for every six hours in which a user was silent."""
    return S.idle_frames(raw(spark, sf, "events"), "user_id", 6 * 3600)
