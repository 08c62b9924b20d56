"""Queries over documents, pages, vectors and benchmark questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import blocks as B
from quarry.operators import impact as I
from quarry.operators import quality as Q
from quarry.operators import retrieval as R
from quarry.operators import vector_index as N
from quarry.operators import vocabulary as V
from quarry.queries.registry import query
from quarry.sources import files
from quarry.sources.shared import settled
from quarry.sources.tables import raw, spread

WORDS = "docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents), tf AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(words) AS token FROM docs) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)"
NUMBERED = "ids AS (SELECT token, df, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM df)"
WEIGHTS = "w AS (SELECT doc_id, token_id, (1 + ln(c)) / (1 + ln(max(c) OVER (PARTITION BY doc_id))) * idf AS w FROM tf LEFT JOIN ids USING (token))"
QUESTIONS = "q AS (SELECT item_id, token, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark) GROUP BY 1, 2), qw AS (SELECT item_id, token_id, (1 + ln(c)) / (1 + ln(m)) * idf AS w FROM (SELECT *, max(c) OVER (PARTITION BY item_id) AS m FROM q) JOIN ids USING (token))"
SCORES = "s AS (SELECT item_id, doc_id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (token_id) GROUP BY 1, 2 HAVING round(sum(qw.w * w.w), 6) > 0), top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def worded(spark, sf, table="documents", key="doc_id"):
    return spread(raw(spark, sf, table).select(key, "text"), key).select(key, X.letter_words(F.col("text")).alias("words"))


def vocabulary(spark, sf):
    return V.with_idf(settled(V.with_ids(V.document_frequency(worded(spark, sf)))), raw(spark, sf, "documents").count())


def weights(spark, sf, vocab):
    return V.sparse_weights(V.counted_words(worded(spark, sf), "doc_id"), vocab, "doc_id")


def asked_tokens(spark, sf):
    return V.postings(worded(spark, sf, "benchmark", "item_id"), "item_id")


def asked_postings(spark, sf):
    """item_id, token, c of the questions; doc_id, token, c, most of the documents for the questions' tokens alone: texts are cut and counted once."""
    asked = settled(asked_tokens(spark, sf))
    wanted = asked.select("token").distinct()
    return asked, settled(V.counted_words(worded(spark, sf), "doc_id").join(wanted, "token", "left_semi"))


def weighted(spark, sf, asked, posted):
    """(item_id, token, q; doc_id, token, w): weights as the frozen vocabulary gives them, for the questions' tokens."""
    idf = settled(V.with_idf(posted.groupBy("token").agg(F.count("*").alias("df")), raw(spark, sf, "documents").count())).select("token", "idf")
    most = asked.withColumn("most", F.max("c").over(Window.partitionBy("item_id"))).join(idf, "token")
    q = most.select("item_id", "token", X.term_weight(F.col("c"), F.col("most"), F.col("idf")).alias("q"))
    return q, posted.join(idf, "token").select("doc_id", "token", X.term_weight(F.col("c"), F.col("most"), F.col("idf")).alias("w"))


def sparse_hits(spark, sf, asked, posted):
    q, w = weighted(spark, sf, asked, posted)
    return settled(I.search(I.build(w, "doc_id"), q, "item_id"))


def shared_hits(asked, posted):
    """The twenty documents with the most different tokens in common: a list that knows neither counts nor rarity."""
    one = F.lit(1.0).alias("w")
    return settled(B.search(B.pack(posted.select("doc_id", "token", one), "doc_id"), B.pack(asked.select("item_id", "token", one), "item_id"), "doc_id", "item_id"))


@query("doc_frequency", sql("SELECT token, df FROM df", WORDS))
def doc_frequency(spark, sf):
    return V.document_frequency(worded(spark, sf))


@query("term_frequency", sql("SELECT doc_id, count(*) AS distinct_words, max(c) AS most, CAST(sum(c) AS BIGINT) AS words FROM tf GROUP BY 1", WORDS))
def term_frequency(spark, sf):
    return V.counted_words(worded(spark, sf), "doc_id").groupBy("doc_id").agg(F.count("*").alias("distinct_words"), F.max("c").alias("most"), F.sum("c").alias("words"))


@query("vocab_ids", sql("SELECT token, df, token_id FROM ids", WORDS, NUMBERED))
def vocab_ids(spark, sf):
    return V.with_ids(V.document_frequency(worded(spark, sf)))


@query("vocab_append", sql("SELECT token, df, CASE WHEN old THEN row_number() OVER (PARTITION BY old ORDER BY df DESC, token) - 1 ELSE (SELECT count(*) FROM b) + row_number() OVER (PARTITION BY old ORDER BY df DESC, token) - 1 END AS token_id FROM (SELECT token, df, true AS old FROM b UNION ALL SELECT token, df, false FROM df WHERE token NOT IN (SELECT token FROM b))", WORDS, "b AS (SELECT token, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark) GROUP BY 1)"))
def vocab_append(spark, sf):
    """The benchmark's vocabulary is frozen; the documents' new tokens come after it."""
    known = V.with_ids(V.document_frequency(worded(spark, sf, "benchmark", "item_id")))
    return V.with_ids(V.document_frequency(worded(spark, sf)), known).select("token", "df", "token_id")


@query("idf", sql("SELECT token, round(idf, 6) AS idf FROM ids", WORDS, NUMBERED))
def idf(spark, sf):
    return vocabulary(spark, sf).select("token", F.round("idf", 6).alias("idf"))


@query("sparse_weights", sql("SELECT doc_id, count(*) AS n, round(sum(w), 4) AS total FROM w GROUP BY 1", WORDS, NUMBERED, WEIGHTS))
def sparse_weights(spark, sf):
    return weights(spark, sf, vocabulary(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query("sparse_topk", sql("SELECT item_id, doc_id, score, rank FROM top", WORDS, NUMBERED, WEIGHTS, QUESTIONS, SCORES))
def sparse_topk(spark, sf):
    return sparse_hits(spark, sf, *asked_postings(spark, sf)).select("item_id", "doc_id", "score", "rank")


DENSE = "dt AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dt QUALIFY rank <= 20)"


def dense_hits(spark, sf):
    v = raw(spark, sf, "embeddings")
    return R.dense_top(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("dense_topk", sql("SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dr", DENSE))
def dense_topk(spark, sf):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return dense_hits(spark, sf).select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dense_best", sql("SELECT vec_id, round(max(score), 4) AS score FROM dr GROUP BY 1", DENSE))
def dense_best(spark, sf):
    return R.best_over_queries(dense_hits(spark, sf), "vec_id").select("vec_id", F.round("score", 4).alias("score"))


def vector_index(spark, sf):
    v = raw(spark, sf, "embeddings")
    return N.build(v, N.fit(v, key="vec_id"), key="vec_id"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_index_exact", sql("SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dr", DENSE))
def vector_index_exact(spark, sf):
    """dense_topk through the inverted file, lists that cannot hold a better row left out."""
    found = N.search(*vector_index(spark, sf), exact=True)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_index_recall", sql("SELECT query_id, CAST(count(*) AS BIGINT) AS wanted, true AS enough, true AS fewer FROM dr GROUP BY 1", DENSE))
def vector_index_recall(spark, sf):
    """Each question's wanted rows, whether all questions together find at least 0.9 of them, and whether fewer rows than all were compared."""
    index, queries = vector_index(spark, sf)
    probes = N.probes_for(index, raw(spark, sf, "embeddings"), key="vec_id")
    found = settled(N.search(index, queries, probes=probes))
    n = raw(spark, sf, "embeddings").count()
    each = N.recall(found, dense_hits(spark, sf), "vec_id").join(found.select("query_id", "n_scored").distinct(), "query_id")
    every = Window.partitionBy(F.lit(1))  # a row for each question
    return each.select("query_id", F.col("n").alias("wanted"), (F.avg("recall").over(every) >= 0.9).alias("enough"), (F.col("n_scored") < n).alias("fewer"))


PAIRED = "held AS (SELECT doc_id FROM documents JOIN embeddings ON vec_id = doc_id), hq AS (SELECT doc_id AS query_id, token, (1 + ln(c)) / (1 + ln(max(c) OVER (PARTITION BY doc_id))) * idf AS w FROM tf JOIN ids USING (token) WHERE doc_id % 20 = 0 AND doc_id IN (SELECT doc_id FROM held)), hs AS (SELECT query_id, w.doc_id, round(sum(hq.w * w.w), 6) AS score FROM hq JOIN ids USING (token) JOIN w ON w.token_id = ids.token_id WHERE w.doc_id IN (SELECT doc_id FROM held) GROUP BY 1, 2), hr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs QUALIFY rank <= 20)"
HYBRID = "hl AS (SELECT query_id, doc_id, rank FROM hr UNION ALL SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dt WHERE query_id IN (SELECT doc_id FROM held) AND vec_id IN (SELECT doc_id FROM held) QUALIFY rank <= 20), hf AS (SELECT query_id, doc_id, round(CAST(sum(CAST(round(1.0 / (60 + rank), 12) AS DECIMAL(20,12))) AS DOUBLE), 12) AS rrf FROM hl GROUP BY 1, 2)"


@query("hybrid_store", sql("SELECT query_id, doc_id, round(rrf, 8) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS place FROM hf QUALIFY place <= 30", WORDS, NUMBERED, WEIGHTS, PAIRED, DENSE, HYBRID))
def hybrid_store(spark, sf):
    """One store of rows with a text and a vector: rows whose id is divisible by 20 ask with both; the exact dense list and the sparse one are fused."""
    both = raw(spark, sf, "documents").select("doc_id", "text").join(raw(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    ask = F.col("doc_id") % 20 == 0
    index = N.build(both, N.fit(both, key="doc_id"), key="doc_id")
    dense = N.search(index, both.where(ask).select(F.col("doc_id").alias("query_id"), "embedding"), exact=True)
    every = settled(V.counted_words(worded(spark, sf), "doc_id"))
    idf = settled(V.with_idf(every.groupBy("token").agg(F.count("*").alias("df")), raw(spark, sf, "documents").count())).select("token", "idf")
    held = every.join(both.select("doc_id"), "doc_id", "left_semi").join(idf, "token").select("doc_id", "token", X.term_weight(F.col("c"), F.col("most"), F.col("idf")).alias("w"))
    packed = B.pack(held, "doc_id")
    sparse = B.search(packed, packed.where(ask).withColumnRenamed("doc_id", "query_id"), "doc_id", "query_id")
    return R.fused([dense, sparse], "query_id", "doc_id").select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"), "place")


SHARED = "shared AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(*) AS score FROM q JOIN tf USING (token) GROUP BY 1, 2) QUALIFY rank <= 20)"
FUSE = "l AS (SELECT item_id, doc_id, rank FROM top UNION ALL SELECT item_id, doc_id, rank FROM shared), rrf AS (SELECT item_id, doc_id, round(CAST(sum(CAST(round(1.0 / (60 + rank), 12) AS DECIMAL(20,12))) AS DOUBLE), 12) AS rrf FROM l GROUP BY 1, 2)"


@query("rrf_fusion", sql("SELECT item_id, doc_id, round(rrf, 8) AS rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS place FROM rrf QUALIFY place <= 30", WORDS, NUMBERED, WEIGHTS, QUESTIONS, SCORES, SHARED, FUSE))
def rrf_fusion(spark, sf):
    """The sparse list and the list of shared tokens."""
    both = asked_postings(spark, sf)
    return R.fused([sparse_hits(spark, sf, *both), shared_hits(*both)], "item_id", "doc_id").select("item_id", "doc_id", F.round("rrf", 8).alias("rrf"), "place")


@query("recall_at_k", sql("SELECT item_id AS query_id, round(avg(CASE WHEN doc_id IN (SELECT doc_id FROM top t WHERE t.item_id = e.item_id AND rank <= 8) THEN 1 ELSE 0 END), 6) AS recall, count(*) AS expected FROM (SELECT item_id, doc_id FROM shared WHERE rank <= 10) e GROUP BY 1", WORDS, NUMBERED, WEIGHTS, QUESTIONS, SCORES, SHARED))
def recall_at_k(spark, sf):
    both = asked_postings(spark, sf)
    hits = sparse_hits(spark, sf, *both).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("key"), "rank")
    wanted = shared_hits(*both).where("rank <= 10").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("key"))
    return Q.recall_at(wanted, hits, 8)


@query("content_hash", "SELECT doc_id, sha256(text) AS hash, length(text) AS chars FROM documents")
def content_hash(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("chars"))


META = "m AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE DATE '1997-01-01' + CAST(doc_id % 300 AS INTEGER) END AS effective_from, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE DATE '1997-06-01' + CAST(doc_id % 400 AS INTEGER) END AS effective_to FROM documents)"


def metadata(spark, sf):
    d, k = raw(spark, sf, "documents"), F.col("doc_id")
    start = F.when(k % 7 != 0, F.date_add(F.lit("1997-01-01").cast("date"), (k % 300).cast("int")))
    end = F.when(k % 5 != 0, F.date_add(F.lit("1997-06-01").cast("date"), (k % 400).cast("int")))
    roles = F.when(F.col("lang") == "en", F.array(F.lit("ADMIN"), F.lit("ANALYST"))).otherwise(F.array(F.lit("ADMIN")))
    return d.select("doc_id", F.col("source").alias("department"), F.upper("lang").alias("classification"), start.alias("effective_from"), end.alias("effective_to"), F.lit("ACTIVE").alias("status"), roles.alias("allowed_roles"))


@query("metadata_filter", sql("SELECT doc_id FROM m WHERE lang = 'en' AND source IN ('src0', 'src3') AND (effective_from IS NULL OR effective_from <= DATE '1997-08-01') AND (effective_to IS NULL OR DATE '1997-08-01' <= effective_to)", META))
def metadata_filter(spark, sf):
    from datetime import date

    return R.permitted(metadata(spark, sf), roles=("ANALYST",), day=date(1997, 8, 1), departments=("src0", "src3")).select("doc_id")


@query("effective_interval", sql("SELECT doc_id, lang FROM m WHERE (effective_from IS NULL OR effective_from <= DATE '1997-08-01') AND (effective_to IS NULL OR DATE '1997-08-01' <= effective_to)", META))
def effective_interval(spark, sf):
    return metadata(spark, sf).where(R.effective(F.col("effective_from"), F.col("effective_to"), F.lit("1997-08-01").cast("date"))).select("doc_id", F.lower("classification").alias("lang"))


@query("normalised_text")
def normalised_text(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.sha2(X.normalised("text"), 256).alias("hash"))


@query("word_segmentation")
def word_segmentation(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.size(X.segmented("text")).alias("n_words"))


@query("chunks")
def chunks(spark, sf):
    out = files.chunked(raw(spark, sf, "documents"), "doc_id")
    return out.select("doc_id", "ordinal", files.chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), F.length("text").alias("chars"), F.sha2("text", 256).alias("hash"))


@query("page_blocks")
def page_blocks(spark, sf):
    pages = raw(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("HTML").alias("format"), F.encode("html", "utf-8").alias("content"))
    blocks = files.parsed(pages).select(F.col("path").cast("long").alias("page_id"), F.posexplode("blocks").alias("place", "b"))
    return blocks.select("page_id", "place", "b.kind", "b.level", F.sha2(F.coalesce("b.text", F.lit("")), 256).alias("hash"), F.size("b.rows").alias("n_rows"))


@query("repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_lines(spark, sf):
    return Q.repeated_lines(raw(spark, sf, "documents"))


@query("injection_kept_as_text", "SELECT doc_id, contains(lower(text), 'ignore') AS mentions, regexp_matches(text, 'https?://') AS has_link FROM documents")
def injection_kept_as_text(spark, sf):
    t = F.col("text")
    return raw(spark, sf, "documents").select("doc_id", F.lower(t).contains("ignore").alias("mentions"), t.rlike("https?://").alias("has_link"))


@query("heading_and_caption_lines", "SELECT doc_id, count(*) AS n_lines, count(CASE WHEN regexp_matches(line, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十]+[章条]|（[一二三四五六七八九十]+）)') THEN 1 END) AS numbered, count(CASE WHEN regexp_matches(line, '^表[：:]') THEN 1 END) AS captions FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def heading_and_caption_lines(spark, sf):
    lines = raw(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(X.heading_level(F.col("line")) > 0, 1)).alias("numbered"), F.count(X.table_caption(F.col("line"))).alias("captions"))


@query("format_detection", "SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'HTML' WHEN url LIKE '%.pdf' THEN 'PDF' WHEN url LIKE '%.txt' THEN 'TXT' END AS format, sha256(html) AS checksum, strlen(html) <= 52428800 AS accepted FROM pages")
def format_detection(spark, sf):
    return raw(spark, sf, "pages").select("page_id", files.format_of(F.col("url")).alias("format"), F.sha2("html", 256).alias("checksum"), (F.octet_length("html") <= files.MOST_BYTES).alias("accepted"))
