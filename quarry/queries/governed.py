"""Queries of governed SQL, and of retrieval, evidence and review rules that have SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import Principal
from quarry.operators import evidence as E
from quarry.operators import retrieval as R
from quarry.operators import review as V
from quarry.plans import guard as G
from quarry.queries.registry import query
from quarry.queries.sales import sql
from quarry.sources import tables as T

#: label, text, and the outcome that is wanted: OK or the kind of refusal.
ATTEMPTS = (
    ("plain", "SELECT region_name FROM dim_region", "OK"),
    ("count", "SELECT COUNT(*) AS n FROM fact_sales", "OK"),
    ("join", "SELECT r.region_name, SUM(f.net) AS n FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key GROUP BY r.region_name", "OK"),
    ("with", "WITH x AS (SELECT line, SUM(net) AS n FROM fact_sales GROUP BY line) SELECT line, n FROM x ORDER BY n DESC LIMIT 5", "OK"),
    ("derived", "SELECT t.line FROM (SELECT line FROM fact_sales) t", "OK"),
    ("case", "SELECT SUM(CASE WHEN line = 'A' THEN net END) / NULLIF(SUM(net), 0) AS share FROM fact_sales WHERE channel IN ('BUILDING', 'x')", "OK"),
    ("like_null", "SELECT line FROM dim_line WHERE line LIKE '%1%' AND line IS NOT NULL", "OK"),
    ("drop", "DROP TABLE fact_sales", "SECURITY"),
    ("insert", "INSERT INTO dim_region SELECT region_name FROM dim_region", "SECURITY"),
    ("update", "UPDATE dim_region SET region_name = 'x'", "SECURITY"),
    ("delete", "DELETE FROM dim_region", "SECURITY"),
    ("two", "SELECT region_name FROM dim_region; SELECT line FROM dim_line", "SECURITY"),
    ("comment", "SELECT region_name FROM dim_region -- x", "SECURITY"),
    ("hint", "SELECT /*+ BROADCAST(dim_region) */ region_name FROM dim_region", "SECURITY"),
    ("union", "SELECT region_name FROM dim_region UNION SELECT line FROM dim_line", "SECURITY"),
    ("union_in_cte", "WITH x AS (SELECT line FROM dim_line UNION ALL SELECT line FROM dim_line) SELECT line FROM x", "SECURITY"),
    ("recursive", "WITH RECURSIVE x AS (SELECT line FROM dim_line) SELECT line FROM x", "SECURITY"),
    ("star", "SELECT * FROM dim_region", "REPAIRABLE"),
    ("table_star", "SELECT r.* FROM dim_region r", "REPAIRABLE"),
    ("hidden_column", "SELECT customer_name FROM dim_customer", "SECURITY"),
    ("quoted_hidden_column", "SELECT `customer_name` AS x FROM dim_customer", "SECURITY"),
    ("unknown_column", "SELECT no_such_column FROM dim_region", "REPAIRABLE"),
    ("unknown_table", "SELECT x FROM secrets", "SECURITY"),
    ("schema_table", "SELECT table_name FROM information_schema.tables", "SECURITY"),
    ("path_table", "SELECT id FROM parquet.`/etc/passwd`", "SECURITY"),
    ("function_table", "SELECT id FROM range(3)", "SECURITY"),
    ("subquery_table", "SELECT line FROM dim_line WHERE line IN (SELECT x FROM secrets)", "SECURITY"),
    ("java", "SELECT java_method('java.lang.Runtime', 'x') FROM dim_region", "SECURITY"),
    ("quoted_java", "SELECT `java_method`('java.lang.System', 'getProperty', 'user.name') AS x FROM dim_region", "SECURITY"),
    ("quoted_reflect", "SELECT `reflect`('java.util.UUID', 'randomUUID') AS x FROM dim_region", "SECURITY"),
    ("quoted_window", "SELECT `row_number`() OVER (ORDER BY region_name) AS x FROM dim_region", "SECURITY"),
    ("current_user", "SELECT current_user AS x FROM dim_region", "SECURITY"),
    ("sleep", "SELECT SLEEP(5) FROM dim_region", "SECURITY"),
    ("unlisted", "SELECT SOUNDEX(region_name) FROM dim_region", "REPAIRABLE"),
    ("window", "SELECT ROW_NUMBER() OVER (ORDER BY net) FROM fact_sales", "REPAIRABLE"),
    ("exists", "SELECT line FROM dim_line WHERE EXISTS (SELECT line FROM dim_line)", "REPAIRABLE"),
    ("comma_join", "SELECT f.net FROM fact_sales f, dim_region r", "REPAIRABLE"),
    ("cross_join", "SELECT f.net FROM fact_sales f CROSS JOIN dim_region r", "REPAIRABLE"),
    ("using", "SELECT f.net FROM fact_sales f JOIN dim_region r USING (region_key)", "REPAIRABLE"),
    ("no_such_join", "SELECT f.net FROM fact_sales f JOIN sales_target t ON f.line = t.line", "SECURITY"),
    ("alias_of_itself", "SELECT b AS b FROM dim_region", "REPAIRABLE"),
    ("column_of_another", "SELECT r.net FROM dim_region r", "REPAIRABLE"),
    ("alias_in_where", "SELECT f.net AS x FROM fact_sales f WHERE x > 1", "REPAIRABLE"),
    ("hiding_cte", "WITH dim_customer AS (SELECT customer_name AS customer_name FROM dim_customer) SELECT customer_name FROM dim_customer", "SECURITY"),
    ("hidden_in_derived", "SELECT t.n FROM (SELECT MAX(customer_name) AS n FROM dim_customer) t", "SECURITY"),
    ("true_join", "SELECT f.net FROM fact_sales f JOIN dim_region r ON 1 = 1", "REPAIRABLE"),
    ("one_sided_join", "SELECT f.net FROM fact_sales f JOIN dim_region r ON f.region_key = f.region_key", "REPAIRABLE"),
    ("other_column_join", "SELECT f.net FROM fact_sales f JOIN dim_region r ON f.cust_key = r.region_key", "REPAIRABLE"),
    ("bind", "SELECT region_name FROM dim_region WHERE region_name = :who", "REPAIRABLE"),
    ("broken", "SELECT region_name FROM", "REPAIRABLE"),
    ("show", "SHOW TABLES", "SECURITY"),
    ("set", "SET spark.sql.ansi.enabled = false", "SECURITY"),
    ("variable", "SELECT @@version FROM dim_region", "SECURITY"),
)


#: How many rows the accepted texts give, in SQL of their own.
ACCEPTED = {
    "plain": "(SELECT count(*) FROM region)",
    "count": "1",
    "join": "(SELECT count(DISTINCT n_regionkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "with": "(SELECT least(5, count(DISTINCT p_brand)) FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "derived": "(SELECT least(1000, count(*)) FROM lineitem)",
    "case": "1",
    "like_null": "(SELECT count(DISTINCT p_brand) FROM part WHERE p_brand LIKE '%1%')",
}


def star(spark, sf) -> dict:
    """The tables that the registered texts read."""
    nations = T.raw(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region_key")).agg(F.count("*").cast("int").alias("province_count"))
    regions = T.raw(spark, sf, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name")).join(nations, "region_key")
    return {"fact_sales": T.sales(spark, sf), "dim_region": regions, "dim_line": T.products(spark, sf).select("line").distinct()}


@query("governed_checks", "SELECT label, outcome, CAST(n_rows AS BIGINT) AS n_rows FROM (VALUES " + ", ".join(f"('{label}', '{wanted}', {ACCEPTED.get(label, 'NULL')})" for label, _, wanted in ATTEMPTS) + ") t(label, outcome, n_rows)")
def governed_checks(spark, sf):
    """What the guard says of each text, and how many rows the tables give to those that it lets through."""
    tables = star(spark, sf)

    def outcome(text: str) -> tuple[str, int | None]:
        try:
            return "OK", len(G.execute(spark, tables, text, seconds=None).rows)
        except G.Refused as e:
            return e.kind, None

    return spark.createDataFrame([(label, *outcome(text)) for label, text, _ in ATTEMPTS], "label string, outcome string, n_rows long")


#: Kinds of predicates over a month m, and the days they read in SQL.
KINDS = (
    ("order_date >= '{m}' AND order_date < DATE_ADD(DATE('{m}'), INTERVAL 1 MONTH)", "m", "m + INTERVAL 1 MONTH"),
    ("order_date BETWEEN '{m}' AND LAST_DAY('{m}')", "m", "last_day(m)"),
    ("order_date = '{m}' OR order_date = DATE_ADD(DATE('{m}'), INTERVAL 10 DAY)", "m", "m + INTERVAL 10 DAY"),
    ("NOT (order_date < DATE_SUB(DATE('{m}'), INTERVAL 7 DAY) OR order_date > '{m}')", "m - INTERVAL 7 DAY", "m"),
    ("DATE_FORMAT(order_date, '%Y-%m') = SUBSTRING('{m}', 1, 7)", "m", "m + INTERVAL 1 MONTH"),
    ("YEAR(order_date) = YEAR('{m}')", "date_trunc('year', m)", "date_trunc('year', m) + INTERVAL 1 YEAR"),
    ("order_date >= '{m}' AND (order_date < DATE_ADD(DATE('{m}'), INTERVAL 1 MONTH) OR line = 'Brand#11')", "NULL", "NULL"),
)


@query(
    "governed_ranges",
    "WITH months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_orderpriority AS p FROM orders), k AS (SELECT m, max(p) AS p, CAST((year(m) * 12 + month(m)) % 7 AS INTEGER) AS kind FROM months GROUP BY m) "
    "SELECT CAST(m AS VARCHAR) AS month, kind, CASE kind " + " ".join(f"WHEN {i} THEN CAST(CAST({a} AS DATE) AS VARCHAR)" for i, (_, a, _) in enumerate(KINDS)) + " END AS first_day, CASE kind " + " ".join(f"WHEN {i} THEN CAST(CAST({b} AS DATE) AS VARCHAR)" for i, (_, _, b) in enumerate(KINDS)) + " END AS last_day, CASE WHEN kind = 6 THEN NULL ELSE p END AS channel FROM k",
)
def governed_ranges(spark, sf):
    """A text of each month of the orders, in one of seven ways to say which days it reads; from its predicates the guard tells them and the fixed channel."""
    months = T.raw(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.max("o_orderpriority").alias("p"))
    found = []
    for r in months.collect():  # a row for each month of the business
        kind = (r["m"].year * 12 + r["m"].month) % len(KINDS)
        where = KINDS[kind][0].format(m=r["m"].isoformat())
        scope = "" if kind == 6 else f" AND channel = '{r['p']}'"
        checked = G.check(spark, f"SELECT SUM(net) AS n FROM fact_sales WHERE ({where}){scope}")
        found.append((r["m"].isoformat(), kind, *(checked.time_range or (None, None)), checked.filters.get("channel")))
    return spark.createDataFrame(found, "month string, kind int, first_day string, last_day string, channel string")


def governed(spark, sf, text: str, schema: str, who: Principal | None = None, **options):
    result = G.execute(spark, star(spark, sf), text, who=who, seconds=None, **options)
    return spark.createDataFrame([tuple(r) for r in result.rows], schema)


@query("governed_result", sql("SELECT region_name, count(*) AS lines, CAST(sum(quantity) AS DOUBLE) AS quantity FROM fact WHERE order_date >= DATE '1997-01-01' AND region_key IN (1, 2) GROUP BY 1"))
def governed_result(spark, sf):
    """A join and sums through the guard, for a principal of two regions, with binds."""
    text = "SELECT r.region_name, COUNT(*) AS lines, CAST(SUM(f.quantity) AS DOUBLE) AS quantity FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key WHERE f.order_date >= :start GROUP BY r.region_name"
    return governed(spark, sf, text, "region_name string, lines long, quantity double", Principal("ANALYST", (1, 2)), binds={"start": "1997-01-01"})


@query("governed_limit", sql("SELECT order_key, line FROM (SELECT DISTINCT order_key, line FROM fact) ORDER BY order_key, line LIMIT 1000"))
def governed_limit(spark, sf):
    """A limit above the most is clamped."""
    return governed(spark, sf, "SELECT DISTINCT order_key, line FROM fact_sales ORDER BY order_key, line LIMIT 999999", "order_key long, line string")


@query("governed_functions", sql("SELECT month, n, q FROM (SELECT month(order_date) AS month, count(*) AS n, CAST(sum(CASE WHEN quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS q FROM fact WHERE order_date >= DATE '1996-01-15' AND order_date < DATE '1997-01-15' + INTERVAL 30 DAY GROUP BY 1)"))
def governed_functions(spark, sf):
    """MONTH, IF, IFNULL, STR_TO_DATE, CONVERT, DATE_ADD and DATE_SUB through the dialect."""
    text = (
        "SELECT MONTH(order_date) AS month, COUNT(*) AS n, CONVERT(SUM(IF(IFNULL(quantity, 0) > 25, 1, 0)), BIGINT) AS q FROM fact_sales "
        "WHERE order_date >= STR_TO_DATE('1996-01-15', '%Y-%m-%d') AND order_date < DATE_ADD(DATE_SUB(STR_TO_DATE('1997-01-16', '%Y-%m-%d'), INTERVAL 1 DAY), INTERVAL 30 DAY) GROUP BY MONTH(order_date)"
    )
    return governed(spark, sf, text, "month int, n long, q long")


@query("like_and_null", "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS open FROM orders WHERE o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '_-HIGH'")
def like_and_null(spark, sf):
    o = T.raw(spark, sf, "orders")
    return o.where(F.col("o_orderpriority").like("%URGENT%") | F.col("o_orderpriority").like("_-HIGH")).select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).isNull().alias("open"))


@query("vector_count", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_count(spark, sf):
    return T.raw(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("secret_leaks", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*\S{6,}')")
def secret_leaks(spark, sf):
    return V.leaks(T.raw(spark, sf, "documents")).select("doc_id")


@query("comparable_scope", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 2 = 0 THEN false ELSE o_orderstatus = 'F' END AS comparable FROM orders")
def comparable_scope(spark, sf):
    """Left: the order's status, or nothing; right: nothing, status F, or status and priority."""
    none = F.expr("cast(map() as map<string,string>)")
    left = F.when(F.col("o_orderkey") % 3 == 0, none).otherwise(F.create_map(F.lit("status"), F.col("o_orderstatus")))
    right = F.when(F.col("o_orderkey") % 5 == 0, none).when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("status"), F.lit("F")))
    return T.raw(spark, sf, "orders").select("o_orderkey", E.comparable(left, right).alias("comparable"))


@query("exact_headers", "SELECT table_id, metric, row_no FROM (SELECT l_orderkey AS table_id, l_linestatus AS metric, l_linenumber AS row_no, l_returnflag = 'A' AS exact, bool_or(l_returnflag = 'A') OVER (PARTITION BY l_orderkey, l_linestatus) AS any_exact FROM lineitem WHERE l_linenumber % 3 <> 0) WHERE exact OR NOT any_exact")
def exact_headers(spark, sf):
    li = T.raw(spark, sf, "lineitem")
    dims = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    claims = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("row_no"), (F.col("l_returnflag") == "A").alias("exact"), dims.alias("dims"))
    return E.exact_headers(claims).select("table_id", "metric", "row_no")


@query(
    "evidence_coverage",
    "WITH c AS (SELECT o_custkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN [o_orderkey, o_orderkey + 1] ELSE [] END AS ids FROM orders), k AS (SELECT task_id, unnest(ids) AS e FROM c), d AS (SELECT DISTINCT task_id, e FROM k) "
    "SELECT task_id, CAST(floor(100.0 * cited / n) AS BIGINT) AS cited, CAST(coalesce(floor(100.0 * hit / m), 0) AS BIGINT) AS known FROM (SELECT task_id, count(*) AS n, sum(CASE WHEN len(ids) > 0 THEN 1 ELSE 0 END) AS cited FROM c GROUP BY 1) "
    "LEFT JOIN (SELECT task_id, count(*) AS m, sum(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END) AS hit FROM d LEFT JOIN orders ON o_orderkey = e AND o_orderstatus = 'F' GROUP BY 1) USING (task_id)",
)
def evidence_coverage(spark, sf):
    o = T.raw(spark, sf, "orders")
    key = F.col("o_orderkey")
    ids = F.when(F.col("o_orderstatus") == "F", F.array(key, key + 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return V.coverage(o.select(F.col("o_custkey").alias("task_id"), ids.alias("evidence_ids")), o.where("o_orderstatus = 'F'").select(key.alias("evidence_id")))


@query("reranked_hits", f"SELECT query_id, hit, place FROM (SELECT l_orderkey AS query_id, l_linenumber AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS place FROM lineitem WHERE l_discount >= {R.RERANK_FLOOR}) WHERE place <= {R.FINAL}")
def reranked_hits(spark, sf):
    """Lines of an order as hits, their discount as the second score."""
    hits = T.raw(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("hit"), F.col("l_linenumber").alias("place"), "l_discount")
    found = R.reranked(hits, lambda h: h.withColumn("rerank", F.col("l_discount")), "query_id", "hit")
    return found.select("query_id", "hit", F.col("place").cast("long").alias("place"))


@query("refusals", f"SELECT c_custkey AS query_id, c_acctbal / 10000 < {R.DENSE_FLOOR} OR c_custkey % 7 = 0 AS refused FROM customer")
def refusals(spark, sf):
    c = T.raw(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_acctbal") / 10000).alias("best"))
    return R.refused(c, c.where("query_id % 7 = 0").select("query_id", F.lit("x").alias("token")))


@query("unseen_topics", "WITH w AS (SELECT DISTINCT p_partkey AS query_id, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN 'zq' ELSE '' END AS token FROM part), v AS (SELECT DISTINCT lower(p_type) AS known FROM part WHERE lower(p_type) < 'm') SELECT query_id, token FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE contains(token, known) OR contains(known, token))")
def unseen_topics(spark, sf):
    p = T.raw(spark, sf, "part")
    token = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "zq").otherwise(""))
    words = p.select(F.col("p_partkey").alias("query_id"), token.alias("token"))
    return R.unseen_topics(words, p.where("lower(p_type) < 'm'").select(F.lower("p_type").alias("token")).distinct(), words.select("token").distinct())
