"""Queries over evidence, conflicts, reviews, conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog import CATALOG, Principal, visible
from quarry.operators import evidence as E
from quarry.operators import quality as K
from quarry.operators import retrieval as R
from quarry.operators import review as V
from quarry.queries.registry import query
from quarry.queries.sales import D, sql
from quarry.sources import sinks
from quarry.sources import tables as T
from quarry.streaming import events as S

# order lines of an order stand for a document's table: the order is the document, its status the caption
TABLE = "rows AS (SELECT o_orderkey AS document_id, o_orderpriority AS section, o_orderstatus AS caption, l_linenumber AS char_start, CAST(o_orderkey AS VARCHAR) || '#' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS chunk_id, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey), pos AS (SELECT *, row_number() OVER (PARTITION BY document_id, section, caption ORDER BY char_start, chunk_id) AS row_no, count(*) OVER (PARTITION BY document_id, section, caption) AS n_rows FROM rows)"


def table_rows(spark, sf):
    li, o = T.dealt(T.raw(spark, sf, "lineitem"), "l_orderkey"), T.raw(spark, sf, "orders")
    key = F.concat(F.col("o_orderkey").cast("string"), F.lit("#"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderstatus").alias("caption"), F.col("l_linenumber").alias("char_start"), key.alias("chunk_id"), "l_returnflag", F.col("l_extendedprice").alias("score"))


@query("table_positions", sql("SELECT chunk_id, row_no, n_rows FROM pos", TABLE))
def table_positions(spark, sf):
    return R.table_positions(table_rows(spark, sf)).select("chunk_id", F.col("row_no").cast("long").alias("row_no"), "n_rows")


@query("table_completion", sql("SELECT chunk_id, expanded FROM (SELECT chunk_id, false AS expanded FROM pos WHERE l_returnflag = 'R' UNION ALL SELECT chunk_id, true FROM (SELECT chunk_id, row_number() OVER (PARTITION BY document_id % 40 ORDER BY document_id, section, caption, row_no) AS n FROM pos JOIN part_found USING (document_id, section, caption) WHERE chunk_id NOT IN (SELECT chunk_id FROM h)) WHERE n <= 30)", TABLE, "h AS (SELECT DISTINCT chunk_id FROM pos WHERE l_returnflag = 'R'), part_found AS (SELECT document_id, section, caption FROM pos WHERE chunk_id IN (SELECT chunk_id FROM h) GROUP BY 1, 2, 3 HAVING count(*) < max(n_rows) AND max(n_rows) <= 12)"))
def table_completion(spark, sf):
    rows = table_rows(spark, sf)
    hits = rows.where("l_returnflag = 'R'").select((F.col("document_id") % 40).alias("query_id"), "chunk_id", "score")
    return R.completed(hits, rows.drop("score"), query="query_id").select("chunk_id", "expanded")


@query("incomplete_tables", sql("SELECT document_id, section, caption, count(DISTINCT row_no) AS covered, max(n_rows) AS total FROM pos WHERE l_returnflag = 'R' GROUP BY 1, 2, 3 HAVING count(DISTINCT row_no) < max(n_rows)", TABLE))
def incomplete_tables(spark, sf):
    return V.incomplete_tables(R.table_positions(table_rows(spark, sf)).where("l_returnflag = 'R'"))


@query("citation_ranges", sql("SELECT document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, '、' ORDER BY a) AS ranges FROM (SELECT document_id, min(n) AS a, max(n) AS b FROM (SELECT document_id, n, n - row_number() OVER (PARTITION BY document_id ORDER BY n) AS g FROM (SELECT DISTINCT document_id, char_start AS n FROM rows WHERE l_returnflag <> 'N')) GROUP BY document_id, g) GROUP BY 1", TABLE))
def citation_ranges(spark, sf):
    return V.ranges(table_rows(spark, sf).where("l_returnflag <> 'N'"), "char_start", "document_id")


@query("sql_evidence_rows", sql("SELECT row_number() OVER (ORDER BY region_name) AS ordinal, 'region_name=' || region_name || '；n=' || n AS claim FROM (SELECT region_name, count(*) AS n FROM fact GROUP BY 1)"))
def sql_evidence_rows(spark, sf):
    result = T.sales(spark, sf, dims=("customer",)).groupBy("region_name").agg(F.count("*").alias("n"))
    return E.sql_evidence(result, "by-region", ["region_name"]).select(F.col("ordinal").cast("long").alias("ordinal"), "claim")


MONTHS = f"actual AS (SELECT strftime(order_date, '%Y-%m') AS period, region_name AS region, {D.format('net')} AS value FROM fact GROUP BY 1, 2)"


def monthly(spark, sf):
    f = T.sales(spark, sf, dims=("customer",)).groupBy(F.date_format("order_date", "yyyy-MM").alias("period"), F.col("region_name").alias("region")).agg(F.sum("net").cast("double").alias("value"))
    key = F.concat_ws("/", "period", "region")
    return f.select(key.alias("fact_id"), F.lit("net_sales").alias("metric"), "period", F.create_map(F.lit("region"), "region").alias("scope"), "value")


def reported(facts):
    """What reports would claim: every fact in units of 10,000; one in three is two percent off, one in five was cut off early."""
    k = F.crc32("fact_id")
    value = F.round(F.col("value") / 10_000 * F.when(k % 3 == 0, 1.02).otherwise(1.0), 4)
    early = F.when(k % 5 == 0, F.to_date(F.concat("period", F.lit("-15"))))
    return facts.select(F.concat(F.lit("c:"), "fact_id").alias("claim_id"), F.col("fact_id").alias("evidence_id"), "metric", "period", "scope", value.alias("value"), F.lit("万元").alias("unit"), early.alias("cutoff"))


@query("value_and_time_conflicts")
def value_and_time_conflicts(spark, sf):
    """Claims of reports against facts; held against brute force in the tests, as the planted errors come from a CRC."""
    facts = monthly(spark, sf)
    return E.conflicts(reported(facts), facts)


CLAIMS = "c AS (SELECT period, region, CASE WHEN region = 'ASIA' THEN round(value / 10000 * 1.02, 4) ELSE round(value / 10000, 4) END * 10000 AS claimed, value FROM actual)"


@query("value_conflicts", sql("SELECT 'VALUE' AS kind, period || '/' || region AS fact_id, round(round(claimed, 4) - value, 2) AS delta FROM c WHERE abs(round(claimed, 4) - value) > greatest(1.0, 0.001 * abs(value))", MONTHS, CLAIMS))
def value_conflicts(spark, sf):
    facts = monthly(spark, sf)
    value = F.round(F.col("value") / 10_000 * F.when(F.col("scope")["region"] == "ASIA", 1.02).otherwise(1.0), 4)
    claims = facts.select(F.col("fact_id").alias("claim_id"), F.col("fact_id").alias("evidence_id"), "metric", "period", "scope", value.alias("value"), F.lit("万元").alias("unit"), F.lit(None).cast("date").alias("cutoff"))
    return E.conflicts(claims, facts).select("kind", "fact_id", F.round("delta", 2).alias("delta"))


@query("time_conflicts", sql("SELECT period || '/' || region AS fact_id FROM actual WHERE CAST(period || '-15' AS DATE) < last_day(CAST(period || '-01' AS DATE)) AND region = 'EUROPE'", MONTHS))
def time_conflicts(spark, sf):
    facts = monthly(spark, sf).where(F.col("scope")["region"] == "EUROPE")
    claims = facts.select(F.col("fact_id").alias("claim_id"), F.col("fact_id").alias("evidence_id"), "metric", "period", "scope", (F.col("value") / 10_000).alias("value"), F.lit("万元").alias("unit"), F.to_date(F.concat("period", F.lit("-15"))).alias("cutoff"))
    # each report in three chunks: its cutoff is one finding
    claims = claims.withColumn("logical_key", F.col("evidence_id")).withColumn("_chunk", F.explode(F.array(*map(F.lit, range(3))))).withColumn("evidence_id", F.concat_ws("#", "evidence_id", "_chunk"))
    return E.conflicts(claims, facts).where("kind = 'TIME'").select("fact_id")


@query("definition_conflicts", "SELECT CAST(o_custkey AS VARCHAR) AS logical_key, 'net_sales' AS metric, o_orderpriority AS document_version, '1-URGENT' AS metric_version FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL")
def definition_conflicts(spark, sf):
    docs = T.raw(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("logical_key"), F.lit("net_sales").alias("metric"), F.col("o_orderpriority").alias("document_version"))
    metrics = spark.createDataFrame([("net_sales", "1-URGENT")], "metric string, metric_version string")
    return E.definition_conflicts(docs, metrics)


@query("review_scores", "SELECT o_custkey AS task_id, greatest(0, 100 - CAST(sum(CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'P' THEN 15 WHEN 'O' THEN 5 ELSE 0 END) AS BIGINT)) AS score, CASE WHEN max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) = 1 THEN 'RETRY' WHEN max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) = 1 THEN 'FAIL' WHEN max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) = 1 THEN 'CLARIFY' ELSE 'PASS' END AS verdict FROM orders GROUP BY 1")
def review_scores(spark, sf):
    severity = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "P", "MEDIUM").when(F.col("o_orderstatus") == "O", "LOW").otherwise("NONE")
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "RETRY").when(F.col("o_orderpriority") == "2-HIGH", "FAIL").when(F.col("o_orderpriority") == "3-MEDIUM", "CLARIFY").otherwise("NONE")
    return V.scores(T.raw(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), severity.alias("severity"), action.alias("action")))


@query("scoped_fact_sum", sql(f"SELECT line, {D.format('net')} AS net_sales FROM fact WHERE region_key IN (2, 3) GROUP BY 1"))
def scoped_fact_sum(spark, sf):
    """What a principal limited to two regions sees: the scope is a filter at the leaf."""
    fact = visible(T.sales(spark, sf), CATALOG.table("fact_sales"), Principal("ANALYST", (2, 3)))
    return fact.groupBy("line").agg(F.sum("net").cast("double").alias("net_sales"))


@query("turn_pairs", "SELECT conv_id, turn, next_turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, lead(turn) OVER w AS next_turn FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def turn_pairs(spark, sf):
    return V.turn_pairs(T.raw(spark, sf, "conversations"))


@query("latest_answer", "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1")
def latest_answer(spark, sf):
    return V.latest(T.raw(spark, sf, "conversations"), "assistant")


@query("latest_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def latest_turns(spark, sf):
    return V.last_then_ascending(T.raw(spark, sf, "conversations"), 10).select("conv_id", "turn", "role")


def events(spark, sf):
    return T.raw(spark, sf, "events")


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf):
    return S.tumbling(S.timed(events(spark, sf)), "1 hour", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("event_sliding", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events, range(3) t(k) GROUP BY 1")
def event_sliding(spark, sf):
    return S.tumbling(S.timed(events(spark, sf)), "3 hours", slide="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("event_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_session(spark, sf):
    return S.sessions(S.timed(events(spark, sf)), "30 minutes", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("event_dedupe", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def event_dedupe(spark, sf):
    return S.first_of(events(spark, sf), "user_id", "event_type").select("user_id", "event_type", "event_id")


@query("stale_users", "SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stale_users(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("ts").alias("now"))
    return S.stale(e, "user_id", now, "2 DAYS")


@query("event_replay", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def event_replay(spark, sf):
    return S.replay(events(spark, sf), 100, 50).select("event_id", "event_type")


@query("event_loss", "SELECT min(event_id) > 6 AS lost, min(event_id) AS earliest FROM events")
def event_loss(spark, sf):
    return S.lost(events(spark, sf), 5)


@query("last_event_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY 1")
def last_event_state(spark, sf):
    return S.last_state(events(spark, sf), "user_id")


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("rate_window")
def rate_window(spark, sf):
    return S.rate_limited(events(spark, sf), 3600, 2)


@query("trace_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def trace_sequence(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("sequence"))


@query("requeue_reconciliation", "SELECT event_id, CASE WHEN user_id % 3 < 2 THEN 'REQUEUE' ELSE 'FAIL' END AS action FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR")
def requeue_reconciliation(spark, sf):
    tasks = events(spark, sf).where("event_type = 'view'").select("event_id", F.lit("QUEUED").alias("status"), F.col("ts").alias("queued_at"), (F.col("user_id") % 3).alias("attempts"))
    return S.requeue(tasks, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "1 HOUR").select("event_id", "action")


@query("keyed_upsert", "SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 3 = 0")
def keyed_upsert(spark, sf):
    old = T.raw(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return sinks.upsert(old, old.where("k % 3 = 0").select("k", F.lit("NEW").alias("v")), "k")


@query("column_merge", "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'fresh', 'X'")
def column_merge(spark, sf):
    old = T.raw(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = old.where("k % 2 = 0").select("k", F.lit("ignored").alias("name"), F.lit("X").alias("segment")).unionAll(spark.createDataFrame([(-1, "fresh", "X")], old.schema))
    return sinks.merged(old, new, "k", ("segment",))


@query("version_delete_and_publish", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN 'ACTIVE' ELSE o_orderstatus END AS status FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'PROCESSING' ELSE o_orderstatus END AS o_orderstatus FROM orders) WHERE o_orderpriority <> '1-URGENT'")
def version_delete_and_publish(spark, sf):
    status = F.when(F.col("o_orderpriority") == "5-LOW", "PROCESSING").otherwise(F.col("o_orderstatus"))
    points = T.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("document_id"), status.alias("status"))
    return sinks.published(sinks.without_version(points, "1-URGENT"), "5-LOW").select("k", "status")


@query("scope_mismatches", "SELECT r_name AS region_name, CAST(4 + r_regionkey % 3 AS BIGINT) AS claimed, count(*) AS province_count FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey HAVING count(*) <> 4 + r_regionkey % 3")
def scope_mismatches(spark, sf):
    regions = T.raw(spark, sf, "region").select(F.col("r_name").alias("region_name"), F.concat(F.lit("the region covers "), (4 + F.col("r_regionkey") % 3).cast("string"), F.lit(" nations")).alias("text"))
    dimension = T.regions(spark, sf).groupBy("region_name").agg(F.count("*").alias("province_count"))
    return K.scope_mismatches(regions, dimension)


@query("header_metrics", "SELECT * FROM (VALUES ('Net Sales（万元）', '万元', 'net_sales', true), ('revenue (元)', '元', 'net_sales', false), ('Returns', NULL, 'return_amount', false)) v(header, unit, metric, exact)")
def header_metrics(spark, sf):
    lexicon = spark.createDataFrame([(a, m.code, i == 0) for m in CATALOG.metrics for i, a in enumerate(m.aliases)], "name string, metric string, exact boolean")
    headers = spark.createDataFrame([("Net Sales（万元）",), ("revenue (元)",), ("Returns",), ("Colour",)], "header string")
    return E.header_metric(headers, lexicon)
