"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numbers, periods
from quarry.operators import analytics as A
from quarry.queries.registry import query
from quarry.sources import tables as T

#: The star in DuckDB; amounts are exact decimals there too.
FACT = """fact AS (SELECT l_orderkey AS order_key, CAST(o_orderdate AS DATE) AS order_date, r_regionkey AS region_key, r_name AS region_name, c_custkey AS cust_key, c_mktsegment AS channel, p_brand AS line, p_type AS category, l_quantity AS quantity, gross, discount,
  CASE WHEN l_returnflag = 'R' THEN gross - discount ELSE 0 END AS returned, CASE WHEN l_returnflag = 'R' THEN 0 ELSE gross - discount END AS net
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l_tax AS DECIMAL(5,2))) AS gross, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(5,2)) AS discount FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey)"""
D = "CAST(sum({}) AS DOUBLE)"


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join((FACT, *ctes)) + " " + body


@query("net_sales_region_quarter", sql(f"SELECT region_name, {D.format('net')} AS net_sales FROM fact WHERE order_date >= DATE '1997-07-01' AND order_date < DATE '1997-10-01' AND region_name = 'ASIA' GROUP BY 1"))
def net_sales_region_quarter(spark, sf):
    start, end = map(str, periods.bounds("1997-Q3"))
    return A.total_by(T.sales(spark, sf, start=start, end=end, dims=("customer",)).where("region_name = 'ASIA'"), "region_name")


@query("net_sales_by_region", sql(f"SELECT region_name, {D.format('net')} AS net_sales FROM fact WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' GROUP BY 1"))
def net_sales_by_region(spark, sf):
    return A.total_by(T.sales(spark, sf, start="1997-01-01", end="1998-01-01", dims=("customer",)), "region_name")


@query("net_sales_by_channel", sql(f"SELECT channel, {D.format('net')} AS net_sales, {D.format('gross')} AS gross_sales FROM fact GROUP BY 1"))
def net_sales_by_channel(spark, sf):
    return A.total_by(T.sales(spark, sf, dims=("customer",)), "channel", net_sales="net", gross_sales="gross")


@query("net_sales_by_line", sql(f"SELECT line, {D.format('net')} AS net_sales FROM fact WHERE order_date >= DATE '1996-01-01' AND order_date < DATE '1996-07-01' GROUP BY 1"))
def net_sales_by_line(spark, sf):
    start, end = map(str, periods.bounds("1996-H1"))
    return A.total_by(T.sales(spark, sf, start=start, end=end, dims=("product",)), "line")


@query("net_sales_region_line", sql(f"SELECT region_name, line, {D.format('net')} AS net_sales, {D.format('discount')} AS discount, {D.format('returned')} AS returned FROM fact GROUP BY 1, 2"))
def net_sales_region_line(spark, sf):
    return A.total_by(T.sales(spark, sf), "region_name", "line", net_sales="net", discount="discount", returned="returned")


@query("top_month", sql(f"SELECT strftime(order_date, '%Y-%m') AS month, {D.format('net')} AS net_sales FROM fact WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' GROUP BY 1 ORDER BY net_sales DESC, month LIMIT 1"))
def top_month(spark, sf):
    fact = T.sales(spark, sf, start="1997-01-01", end="1998-01-01", dims=()).withColumn("month", periods.token_column(F.col("order_date"), "month"))
    return A.total_by(fact, "month").orderBy(F.desc("net_sales"), "month").limit(1)


@query("order_count", sql("SELECT count(order_key) AS order_count, count(DISTINCT order_key) AS distinct_orders FROM fact WHERE region_name = 'EUROPE' AND order_date >= DATE '1997-07-01' AND order_date < DATE '1997-10-01'"))
def order_count(spark, sf):
    return T.sales(spark, sf, start="1997-07-01", end="1997-10-01", dims=("customer",)).where("region_name = 'EUROPE'").agg(F.count("order_key").alias("order_count"), F.countDistinct("order_key").alias("distinct_orders"))


@query("top_return_region", sql(f"SELECT region_name, {D.format('returned')} AS returned FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def top_return_region(spark, sf):
    return A.total_by(T.sales(spark, sf, dims=("customer",)), "region_name", returned="returned").orderBy(F.desc("returned"), "region_name").limit(1)


@query("annual_net_sales", sql(f"SELECT year(order_date) AS year, {D.format('net')} AS net_sales, round(avg(CAST(net AS DOUBLE)), 4) AS mean_line, CAST(min(net) AS DOUBLE) AS least, CAST(max(net) AS DOUBLE) AS most FROM fact GROUP BY 1"))
def annual_net_sales(spark, sf):
    exact_mean = F.round(F.sum("net").cast("double") / F.count("net"), 4)
    return T.sales(spark, sf, dims=()).groupBy(F.year("order_date").cast("long").alias("year")).agg(A.money("net").alias("net_sales"), exact_mean.alias("mean_line"), F.min("net").cast("double").alias("least"), F.max("net").cast("double").alias("most"))


YOY = f"yoy AS (SELECT region_name, line, {D.format('CASE WHEN order_date >= DATE $$1997-07-01$$ AND order_date < DATE $$1997-10-01$$ THEN net END')} AS c, {D.format('CASE WHEN order_date >= DATE $$1996-07-01$$ AND order_date < DATE $$1996-10-01$$ THEN net END')} AS p FROM fact GROUP BY GROUPING SETS ((region_name), (line)))".replace("$$", "'")
NOW, BEFORE = ("1997-07-01", "1997-10-01"), ("1996-07-01", "1996-10-01")


def two_quarters(spark, sf, *dims):
    return T.sales(spark, sf, start=BEFORE[0], end=NOW[1], dims=dims)


@query("yoy_region_quarter", sql("SELECT region_name, c AS current_sales, p AS previous_sales, round(c / nullif(p, 0) - 1, 6) AS yoy FROM yoy WHERE region_name IS NOT NULL", YOY))
def yoy_region_quarter(spark, sf):
    return A.year_over_year(two_quarters(spark, sf, "customer"), NOW, BEFORE, "region_name")


@query("region_delta_contribution", sql("SELECT region_name, round(coalesce(c, 0) - coalesce(p, 0), 2) AS delta, round((coalesce(c, 0) - coalesce(p, 0)) / (SELECT CAST(sum(CAST(coalesce(c, 0) - coalesce(p, 0) AS DECIMAL(28,4))) AS DOUBLE) FROM yoy WHERE region_name IS NOT NULL), 6) AS contribution FROM yoy WHERE region_name IS NOT NULL", YOY))
def region_delta_contribution(spark, sf):
    return A.delta_contribution(A.year_over_year(two_quarters(spark, sf, "customer"), NOW, BEFORE, "region_name"), "region_name")


@query("line_vs_peers", sql("SELECT a.line, a.y AS yoy, max(b.y) AS best_other, coalesce(max(b.y) - a.y >= 0.2, false) AS anomalous FROM z a JOIN z b ON a.line <> b.line GROUP BY 1, 2", YOY, "z AS (SELECT line, round(c / nullif(p, 0) - 1, 6) AS y FROM yoy WHERE line IS NOT NULL)"))
def line_vs_peers(spark, sf):
    return A.against_peers(A.year_over_year(two_quarters(spark, sf, "product"), NOW, BEFORE, "line"), "line")


TARGET = "target AS (SELECT CAST(date_trunc('month', order_date) + INTERVAL 12 MONTH AS DATE) AS period_month, region_name, line, round(CAST(sum(net) AS DOUBLE) * 1.05, 2) AS target FROM fact GROUP BY 1, 2, 3)"


@query("target_derivation", sql("SELECT period_month, region_name, line, target FROM target", TARGET))
def target_derivation(spark, sf):
    return T.targets(T.sales(spark, sf)).select("period_month", "region_name", "line", "target")


@query(
    "target_achievement",
    sql(
        "SELECT t.period_month, t.region_name, t.target, coalesce(actual, 0) AS actual, round(coalesce(actual, 0) / nullif(t.target, 0), 6) AS achievement FROM (SELECT period_month, region_name, CAST(sum(CAST(target AS DECIMAL(18,2))) AS DOUBLE) AS target FROM target GROUP BY 1, 2) t LEFT JOIN (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period_month, region_name, CAST(sum(net) AS DOUBLE) AS actual FROM fact GROUP BY 1, 2) a USING (period_month, region_name)",
        TARGET,
    ),
)
def target_achievement(spark, sf):
    # by month once: actual figures and targets read the same exchange
    fact = T.sales(spark, sf).groupBy(F.trunc("order_date", "month").alias("order_date"), "region_key", "region_name", "line").agg(F.sum("net").alias("net"))
    return A.achievement(fact.withColumn("period_month", F.col("order_date")), T.targets(fact), ["period_month", "region_name"])


@query("share_of_total", sql(f"SELECT category, v AS net_sales, round(v / (SELECT CAST(sum(CAST(v AS DECIMAL(28,4))) AS DOUBLE) FROM t), 6) AS share FROM t", f"t AS (SELECT category, {D.format('net')} AS v FROM fact GROUP BY 1)"))
def share_of_total(spark, sf):
    return A.shares(A.total_by(T.sales(spark, sf, dims=("product",)), "category"), "category", "net_sales")


MEASURES = ", ".join(f"{D.format(x)} AS {x}" for x in ("net", "gross", "discount", "returned")) + ", count(*) AS n_lines"


@query("cutoff_report", sql(f"SELECT region_name, {MEASURES} FROM fact WHERE order_date >= DATE '1997-07-01' AND order_date <= DATE '1997-09-20' GROUP BY 1"))
def cutoff_report(spark, sf):
    return A.report(T.sales(spark, sf, start="1997-07-01", end="1997-10-01", dims=("customer",)), "1997-09-20", "region_name")


@query("region_channel_line_detail", sql(f"SELECT region_name, channel, line, {MEASURES} FROM fact WHERE order_date >= DATE '1997-01-01' AND order_date <= DATE '1997-03-31' GROUP BY 1, 2, 3 HAVING sum(net) <> 0"))
def region_channel_line_detail(spark, sf):
    return A.report(T.sales(spark, sf, start="1997-01-01", end="1997-04-01"), "1997-03-31", "region_name", "channel", "line").where("net <> 0")


@query("daily_fact_load", sql(f"SELECT order_date, region_name, channel, line, {MEASURES} FROM fact GROUP BY 1, 2, 3, 4"))
def daily_fact_load(spark, sf):
    return A.report(T.sales(spark, sf), "9999-12-31", "order_date", "region_name", "channel", "line")


@query("weeks_below_safety", sql("SELECT region_name, line, count(CASE WHEN q < 50 THEN 1 END) AS weeks_below, count(*) AS weeks FROM (SELECT date_trunc('week', order_date) AS w, region_name, line, sum(quantity) AS q FROM fact GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def weeks_below_safety(spark, sf):
    return A.weeks_below(T.inventory(T.sales(spark, sf)), "region_name", "line")


@query("period_bounds", "SELECT t AS token, s AS start_date, e AS end_date FROM (VALUES ('1997', DATE '1997-01-01', DATE '1998-01-01'), ('1997-H2', DATE '1997-07-01', DATE '1998-01-01'), ('1997-q3', DATE '1997-07-01', DATE '1997-10-01'), ('1997-12', DATE '1997-12-01', DATE '1998-01-01'), ('1997-13', NULL, NULL), ('1997Q3', NULL, NULL)) v(t, s, e)")
def period_bounds(spark, sf):
    rows = spark.createDataFrame([(t,) for t in ("1997", "1997-H2", "1997-q3", "1997-12", "1997-13", "1997Q3")], "token string")
    return rows.select("token", periods.start_column(F.col("token")).alias("start_date"), periods.end_column(F.col("token")).alias("end_date"))


@query("period_rollup", sql(f"SELECT strftime(order_date, '%Y') || CASE WHEN month(order_date) <= 6 THEN '-H1' ELSE '-H2' END AS half, strftime(order_date, '%Y') || '-Q' || quarter(order_date) AS quarter, {D.format('net')} AS net_sales FROM fact GROUP BY 1, 2"))
def period_rollup(spark, sf):
    fact = T.sales(spark, sf, dims=())
    return A.total_by(fact.select("net", periods.token_column(F.col("order_date"), "half").alias("half"), periods.token_column(F.col("order_date"), "quarter").alias("quarter")), "half", "quarter")


@query("dimension_values", "SELECT DISTINCT c_mktsegment AS channel FROM customer")
def dimension_values(spark, sf):
    return T.raw(spark, sf, "customer").select(F.col("c_mktsegment").alias("channel")).distinct()


@query("semi_join_scope", "SELECT c_custkey AS cust_key, c_mktsegment AS channel FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
def semi_join_scope(spark, sf):
    wanted = T.regions(spark, sf).where(F.col("region_name").isin("ASIA", "EUROPE"))
    c = T.raw(spark, sf, "customer")
    return c.join(F.broadcast(wanted), c.c_nationkey == wanted.nation_key, "left_semi").select(F.col("c_custkey").alias("cust_key"), F.col("c_mktsegment").alias("channel"))


@query("anti_join_customers", "SELECT c_custkey AS cust_key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_customers(spark, sf):
    c, o = T.raw(spark, sf, "customer"), T.raw(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("cust_key"))


@query("scalar_subqueries", "SELECT CAST((SELECT sum(CAST(o_totalprice AS DECIMAL(14,2))) FROM orders WHERE o_orderstatus = 'F') AS DOUBLE) AS numerator, CAST((SELECT sum(CAST(o_totalprice AS DECIMAL(14,2))) FROM orders) AS DOUBLE) AS denominator")
def scalar_subqueries(spark, sf):
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return T.raw(spark, sf, "orders").agg(A.money(F.when(F.col("o_orderstatus") == "F", price)).alias("numerator"), A.money(price).alias("denominator"))


@query("outer_joins", "SELECT n_name AS nation, count(s_suppkey) AS suppliers, count(DISTINCT r_regionkey) AS regions FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey FULL JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def outer_joins(spark, sf):
    n, s, r = (T.raw(spark, sf, x) for x in ("nation", "supplier", "region"))
    joined = n.join(s, n.n_nationkey == s.s_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "full")
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("s_suppkey").alias("suppliers"), F.countDistinct("r_regionkey").alias("regions"))


@query("p95_order_stat", "SELECT o_orderpriority AS priority, percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice) AS value, count(o_totalprice) AS n FROM orders GROUP BY 1")
def p95_order_stat(spark, sf):
    return A.nearest_rank(T.raw(spark, sf, "orders"), "o_totalprice", 0.95, "o_orderpriority").select(F.col("o_orderpriority").alias("priority"), "value", "n")


@query("even_sampling", "SELECT o_orderkey AS order_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p IN (SELECT (i * (SELECT count(*) FROM orders)) // 20 FROM range(20) t(i))")
def even_sampling(spark, sf):
    return A.even_sample(T.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key")), "order_key", 20)


@query("result_multiset_equality", "SELECT CAST(0 AS BIGINT) AS differing")
def result_multiset_equality(spark, sf):
    """The same totals by two ways: from orders by status, and by two halves put together."""
    o = T.raw(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    halves = o.where("o_orderstatus = 'F'").unionAll(o.where("o_orderstatus <> 'F' or o_orderstatus is null"))
    return A.multiset_difference(o, halves).agg(F.count("*").alias("differing"))


@query("money_format", sql("SELECT region_name, c AS net, printf('%.2f', round(c / 10000, 2)) AS plain FROM (SELECT region_name, CAST(sum(net) AS DOUBLE) AS c FROM fact GROUP BY 1)"))
def money_format(spark, sf):
    totals = A.total_by(T.sales(spark, sf, dims=("customer",)), "region_name", net="net")
    return totals.select("region_name", "net", F.regexp_replace(numbers.in_ten_thousands(F.col("net")), ",", "").alias("plain"))


@query("amount_parsing", "SELECT text, v AS amounts FROM (VALUES ('净额 1,234.5 万元，折扣 2亿', '[12345000.0, 200000000.0]'), ('无', '[]'), ('-3.25 千元 7元', '[-3250.0, 7.0]')) t(text, v)")
def amount_parsing(spark, sf):
    rows = spark.createDataFrame([("净额 1,234.5 万元，折扣 2亿",), ("无",), ("-3.25 千元 7元",)], "text string")
    return rows.select("text", F.concat(F.lit("["), F.array_join(F.transform(numbers.amounts(F.col("text")), lambda x: F.regexp_replace(F.format_number(x, 1), ",", "")), ", "), F.lit("]")).alias("amounts"))


@query("allowed_functions", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS month, quarter(o_orderdate) AS q, last_day(CAST(o_orderdate AS DATE)) AS month_end, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS days_left, CAST(o_orderdate AS DATE) + INTERVAL 30 DAY < DATE '1998-01-01' AS early, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, upper(substring(trim(o_orderpriority), 1, 3)) AS pri, concat(o_orderstatus, '-', lower(o_orderpriority)) AS tag, ceil(o_totalprice) AS hi, floor(o_totalprice) AS lo, abs(CAST(o_orderkey AS BIGINT) - 500) AS off FROM orders")
def allowed_functions(spark, sf):
    o = T.raw(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.quarter("o_orderdate").cast("long").alias("q"), F.last_day(day).alias("month_end"), F.datediff(F.lit("2001-12-31").cast("date"), day).cast("long").alias("days_left"),
        (F.date_add(day, 30) < F.lit("1998-01-01").cast("date")).alias("early"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("open")).alias("status"), F.upper(F.substring(F.trim("o_orderpriority"), 1, 3)).alias("pri"), F.concat("o_orderstatus", F.lit("-"), F.lower("o_orderpriority")).alias("tag"),
        F.ceil("o_totalprice").cast("double").alias("hi"), F.floor("o_totalprice").cast("double").alias("lo"), F.abs(F.col("o_orderkey") - 500).alias("off"),
    )
