import pytest

from quarry.catalog import CATALOG, Principal, visible
from quarry.functions.dialect import translated
from quarry.plans import guard as G
from quarry.sources import tables as T

GOOD = [
    "SELECT region_name FROM dim_region",
    "SELECT r.region_name, SUM(f.net) AS net_sales FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key WHERE f.order_date >= '1997-07-01' AND f.order_date < '1997-10-01' GROUP BY r.region_name",
    "WITH x AS (SELECT line, SUM(net) AS n FROM fact_sales GROUP BY line) SELECT line, n FROM x ORDER BY n DESC LIMIT 5",
    "SELECT t.line FROM (SELECT line FROM fact_sales) t",
    "SELECT COUNT(*) AS n FROM fact_sales",
    "SELECT DATE_FORMAT(order_date, '%Y-%m') AS month, SUM(net) AS n FROM fact_sales GROUP BY DATE_FORMAT(order_date, '%Y-%m')",
    "SELECT SUM(CASE WHEN line = 'A' THEN net END) / NULLIF(SUM(net), 0) AS share FROM fact_sales WHERE channel IN ('BUILDING', 'x') AND NOT (line = 'b')",
    "SELECT p.line, SUM(f.net) AS n FROM fact_sales f JOIN dim_product p ON f.part_key = p.part_key JOIN dim_line l ON p.line = l.line GROUP BY p.line",
    "SELECT region_name FROM dim_region WHERE region_name = 'a;b -- c'",
    "SELECT SUM(net) AS total FROM fact_sales GROUP BY line HAVING total > 3 ORDER BY total",
    "SELECT MONTH(order_date) AS m, SUM(net) AS n FROM fact_sales GROUP BY m ORDER BY n",
    "WITH dim_line AS (SELECT line AS l FROM dim_line) SELECT l FROM dim_line",
    "WITH a AS (SELECT YEAR(order_date) AS y, SUM(net) AS n FROM fact_sales GROUP BY YEAR(order_date)), b AS (SELECT y + 1 AS y, n AS n FROM a) SELECT a.y AS y, a.n - b.n AS d FROM a JOIN b ON a.y = b.y",
    "SELECT r.region_name, x.n FROM (SELECT region_key AS k, SUM(net) AS n FROM fact_sales GROUP BY region_key) x JOIN dim_region r ON x.k = r.region_key",
    "SELECT f.net FROM fact_sales f LEFT JOIN dim_region r ON f.region_key = r.region_key AND r.region_name <> 'x'",
    "SELECT line FROM dim_line WHERE line IN (SELECT line FROM dim_product) AND line = (SELECT MAX(line) FROM dim_product)",
]
BAD = [
    ("DROP TABLE fact_sales", G.SECURITY),
    ("INSERT INTO dim_region SELECT region_name FROM dim_region", G.SECURITY),
    ("UPDATE dim_region SET region_name = 'x'", G.SECURITY),
    ("DELETE FROM dim_region", G.SECURITY),
    ("SELECT region_name FROM dim_region; SELECT line FROM dim_line", G.SECURITY),
    ("SELECT region_name FROM dim_region -- x", G.SECURITY),
    ("SELECT /*+ BROADCAST(dim_region) */ region_name FROM dim_region", G.SECURITY),
    ("SELECT region_name FROM dim_region # x", G.SECURITY),
    ("SELECT region_name FROM dim_region UNION SELECT line FROM dim_line", G.SECURITY),
    ("SELECT * FROM dim_region", G.REPAIRABLE),
    ("SELECT r.* FROM dim_region r", G.REPAIRABLE),
    ("SELECT customer_name FROM dim_customer", G.SECURITY),
    ("SELECT x FROM secrets", G.SECURITY),
    ("SELECT table_name FROM information_schema.tables", G.SECURITY),
    ("SELECT id FROM parquet.`/etc/passwd`", G.SECURITY),
    ("SELECT java_method('java.lang.Runtime', 'x') FROM dim_region", G.SECURITY),
    ("SELECT reflect('java.lang.System', 'exit') FROM dim_region", G.SECURITY),
    ("SELECT SLEEP(5) FROM dim_region", G.SECURITY),
    ("SELECT `reflect`('java.util.UUID', 'randomUUID') FROM dim_region", G.SECURITY),
    ("SELECT `java_method`('java.lang.System', 'getProperty', 'user.name') FROM dim_region", G.SECURITY),
    ("SELECT region_name FROM dim_region WHERE region_name IN (SELECT `reflect`('a', 'b') FROM dim_line)", G.SECURITY),
    ("SELECT region_name FROM dim_region ORDER BY `java_method`('a', 'b')", G.SECURITY),
    ("SELECT `customer_name` FROM dim_customer", G.SECURITY),
    ("SELECT current_user FROM dim_region", G.SECURITY),
    ("SELECT `row_number`() OVER (ORDER BY net) FROM fact_sales", G.SECURITY),
    ("SELECT no_such_column FROM dim_region", G.REPAIRABLE),
    ("SELECT region_name FROM dim_region ORDER BY no_such_column", G.REPAIRABLE),
    ("SELECT id FROM range(3)", G.SECURITY),
    ("SELECT f.net FROM fact_sales f, dim_region r", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f CROSS JOIN dim_region r", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r USING (region_key)", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN sales_target t ON f.line = t.line", G.SECURITY),
    ("SELECT b AS b FROM dim_region", G.REPAIRABLE),
    ("SELECT r.net FROM dim_region r", G.REPAIRABLE),
    ("SELECT f.net AS x FROM fact_sales f WHERE x > 1", G.REPAIRABLE),
    ("SELECT line AS customer_name FROM dim_line WHERE customer_name = 'x'", G.REPAIRABLE),
    ("WITH dim_customer AS (SELECT customer_name AS customer_name FROM dim_customer) SELECT customer_name FROM dim_customer", G.SECURITY),
    ("WITH x AS (SELECT customer_name AS n FROM dim_customer) SELECT n FROM x", G.SECURITY),
    ("SELECT t.n FROM (SELECT MAX(customer_name) AS n FROM dim_customer) t", G.SECURITY),
    ("SELECT cust_key FROM dim_customer ORDER BY customer_name", G.SECURITY),
    ("SELECT line FROM dim_line WHERE line IN (SELECT customer_name FROM dim_customer)", G.SECURITY),
    ("WITH x AS (SELECT line FROM dim_line) SELECT region_name FROM x", G.REPAIRABLE),
    ("SELECT x.n FROM (SELECT line AS l FROM dim_line) x", G.REPAIRABLE),
    ("WITH a AS (SELECT line FROM dim_line), b AS (SELECT line FROM a) SELECT b.line FROM b JOIN c ON b.line = c.line", G.SECURITY),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON 1 = 1", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON f.region_key = f.region_key", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON f.region_key = 3", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON f.region_key > r.region_key", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key OR 1 = 1", G.REPAIRABLE),
    ("SELECT f.net FROM fact_sales f JOIN dim_region r ON f.cust_key = r.region_key", G.REPAIRABLE),
    ("SELECT region_key FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key", G.REPAIRABLE),
    ("SELECT x.line FROM (SELECT line, part_key FROM fact_sales) x JOIN inventory i ON x.line = i.line", G.SECURITY),
    ("SELECT line, net FROM fact_sales GROUP BY line", G.REPAIRABLE),
    ("SELECT line FROM dim_line WHERE line = (SELECT customer_name FROM dim_customer LIMIT 1)", G.SECURITY),
    ("SELECT SOUNDEX(region_name) FROM dim_region", G.REPAIRABLE),
    ("SELECT ROW_NUMBER() OVER (ORDER BY net) FROM fact_sales", G.REPAIRABLE),
    ("SELECT line FROM fact_sales WHERE EXISTS (SELECT line FROM dim_line)", G.REPAIRABLE),
    ("SELECT region_name FROM dim_region WHERE region_name = :who", G.REPAIRABLE),
    ("SELECT region_name FROM", G.REPAIRABLE),
    ("SHOW TABLES", G.SECURITY),
    ("SET spark.sql.ansi.enabled = false", G.SECURITY),
    ("SELECT @@version FROM dim_region", G.SECURITY),
    ("SELECT region_name FROM dim_region INTO OUTFILE 'x'", None),
    ("WITH RECURSIVE x AS (SELECT line FROM dim_line) SELECT line FROM x", G.SECURITY),
    ("SELECT line FROM dim_line WHERE line IN (SELECT x FROM secrets)", G.SECURITY),
]


@pytest.mark.parametrize("sql", GOOD)
def test_good(spark, sql):
    assert G.check(spark, sql).limit <= G.MOST_ROWS


@pytest.mark.parametrize(("sql", "kind"), BAD)
def test_bad(spark, sql, kind):
    with pytest.raises(G.Refused) as e:
        G.check(spark, sql)
    assert kind is None or e.value.kind == kind, e.value


def test_length_limit_and_fingerprint(spark):
    with pytest.raises(G.Refused) as e:
        G.check(spark, "SELECT line FROM dim_line WHERE line = '" + "x" * 9000 + "'")
    assert e.value.kind == G.VALIDATION
    a, b = (G.check(spark, f"SELECT line FROM dim_line WHERE line = '{x}' LIMIT {n}") for x, n in (("a", 5), ("b", 7)))
    assert a.fingerprint == b.fingerprint and (a.limit, b.limit) == (5, 7)
    assert G.check(spark, "SELECT line FROM dim_line LIMIT 999999").limit == 1000


def test_time_range_and_filters(spark):
    c = G.check(spark, GOOD[1])
    assert c.time_range == ("1997-07-01", "1997-10-01")
    assert G.check(spark, "SELECT line FROM fact_sales WHERE channel = 'BUILDING' AND region_key = 2").filters == {"channel": "BUILDING", "region_key": "2"}


RANGES = [
    ("order_date >= '1997-01-01'", None),
    ("order_date >= '1997-01-01' AND order_date <= '1997-02-01'", ("1997-01-01", "1997-02-01")),
    ("'1997-01-01' <= order_date AND '1997-02-01' > order_date", ("1997-01-01", "1997-02-01")),
    ("order_date BETWEEN '1997-01-01' AND LAST_DAY('1997-02-05')", ("1997-01-01", "1997-02-28")),
    ("order_date = '1997-01-05'", ("1997-01-05", "1997-01-05")),
    ("order_date IN ('1997-01-05', '1997-03-05', '1996-12-01')", ("1996-12-01", "1997-03-05")),
    ("order_date >= '1997-01-01' AND order_date < '1997-02-01' OR order_date >= '1996-01-01' AND order_date < '1996-02-01'", ("1996-01-01", "1997-02-01")),
    ("order_date >= '1997-01-01' AND order_date < '1997-02-01' OR line = 'order_date >= 1990-01-01'", None),
    ("NOT (order_date < '1997-01-01' OR order_date >= '1997-02-01')", ("1997-01-01", "1997-02-01")),
    ("NOT (order_date >= '1997-01-01' AND order_date < '1997-02-01')", None),
    ("YEAR(order_date) = 1997", ("1997-01-01", "1998-01-01")),
    ("YEAR(order_date) BETWEEN 1996 AND 1997", ("1996-01-01", "1998-01-01")),
    ("DATE_FORMAT(order_date, '%Y-%m') = '1997-12'", ("1997-12-01", "1998-01-01")),
    ("MONTH(order_date) = 5", None),
    ("order_date >= DATE_SUB(DATE('1997-01-08'), INTERVAL 7 DAY) AND order_date < DATE_ADD(DATE('1997-01-01'), INTERVAL 1 MONTH)", ("1997-01-01", "1997-02-01")),
    ("order_date >= STR_TO_DATE('05/01/1997', '%d/%m/%Y') AND order_date <= :until", ("1997-01-05", "1997-06-30")),
    ("line = '>= 1997-01-01' AND channel <> '<= 1998-01-01'", None),
    ("order_date >= '1997-01-01' AND order_date >= '1997-03-01' AND order_date < '1998-01-01'", ("1997-03-01", "1998-01-01")),
]


@pytest.mark.parametrize(("where", "days"), RANGES)
def test_intervals(spark, where, days):
    assert G.check(spark, f"SELECT SUM(net) AS n FROM fact_sales WHERE {where}", binds={"until": "1997-06-30"}).time_range == days


def test_intervals_of_several_readings(spark):
    two = "WITH a AS (SELECT line, SUM(net) AS n FROM fact_sales WHERE order_date >= '1997-07-01' AND order_date < '1997-10-01' GROUP BY line), b AS (SELECT line, SUM(net) AS n FROM fact_sales WHERE {} GROUP BY line) SELECT a.line, a.n - b.n AS d FROM a JOIN b ON a.line = b.line"
    assert G.check(spark, two.format("order_date >= '1996-07-01' AND order_date < '1996-10-01'")).time_range == ("1996-07-01", "1997-10-01")
    assert G.check(spark, two.format("net > 0")).time_range is None
    twice = "WITH a AS (SELECT line, order_date, SUM(net) AS n FROM fact_sales GROUP BY line, order_date) SELECT x.line, x.n - y.n AS d FROM a x JOIN a y ON x.line = y.line WHERE x.order_date = '1997-01-01' AND y.order_date = '1996-01-01'"
    assert G.check(spark, twice).time_range == ("1996-01-01", "1997-01-01")
    assert G.check(spark, "SELECT SUM(t.target) AS n FROM sales_target t WHERE t.period_month >= '1997-01-01' AND t.period_month <= '1997-06-01'").time_range == ("1997-01-01", "1997-06-01")


def test_fixed_dimensions(spark):
    fixed = lambda where: G.check(spark, f"SELECT SUM(f.net) AS n FROM fact_sales f JOIN dim_region r ON f.region_key = r.region_key WHERE {where}").filters
    assert fixed("r.region_name = 'ASIA'") == {"region_name": "ASIA"}
    assert fixed("r.region_name IN ('ASIA') AND 'x' = f.channel") == {"region_name": "ASIA", "channel": "x"}
    assert fixed("r.region_name IN ('ASIA', 'AFRICA')") == {}
    assert fixed("r.region_name = 'ASIA' OR r.region_name = 'AFRICA'") == {}
    assert fixed("r.region_name = 'ASIA' OR f.line = 'x'") == {}
    assert fixed("NOT r.region_name = 'ASIA' AND f.line = 'a = b'") == {"line": "a = b"}


def test_execution_is_scoped_and_bounded(spark, sf):
    tables = {"fact_sales": T.sales(spark, sf), "dim_customer": T.customers(spark, sf)}
    sql = "SELECT region_key, COUNT(*) AS n FROM fact_sales GROUP BY region_key"
    every = G.execute(spark, tables, sql, seconds=300)
    some = G.execute(spark, tables, sql, who=Principal("ANALYST", (2,)), seconds=300)
    assert len(every.rows) == 5 and [r[0] for r in some.rows] == [2] and some.rows[0] in every.rows
    few = G.execute(spark, tables, "SELECT order_key FROM fact_sales", most=3, seconds=300)
    assert len(few.rows) == 3 and few.truncated
    assert G.execute(spark, tables, "SELECT customer_name FROM dim_customer LIMIT 1", who=Principal("ADMIN"), seconds=300).rows
    empty = G.execute(spark, tables, "SELECT SUM(net) AS n FROM fact_sales WHERE line = 'none'", seconds=300)
    assert empty.empty


def test_repairs(spark):
    def write(question, last):
        return "SELECT * FROM dim_line" if last is None else "SELECT line FROM dim_line"

    found, attempts = G.repaired(spark, write, "lines?")
    assert found and [a[1] for a in attempts] == [G.REPAIRABLE, "OK"]
    found, attempts = G.repaired(spark, lambda q, e: "DROP TABLE x", "drop")
    assert found is None and len(attempts) == 1


def test_dialect():
    assert translated("SELECT DATE_FORMAT(d, '%Y-%m'), CONVERT(x, INT), STR_TO_DATE(s, '%d/%m/%Y'), DATE_ADD(d, INTERVAL 3 DAY)") == "SELECT date_format(d, 'yyyy-MM'), cast(x as INT), to_date(s, 'dd/MM/yyyy'), (d + INTERVAL 3 DAY)"


def test_catalog(spark, sf):
    assert [m.code for m in CATALOG.match_metrics("net sales target by region")] == ["target_amount"]
    assert CATALOG.subset("net sales by region")[0] == "fact_sales" and "dim_region" in CATALOG.subset("net sales by region")
    assert CATALOG.level_of(["customer_name", "line"]) == "SENSITIVE"
    assert "customer_name" not in visible(T.customers(spark, sf), CATALOG.table("dim_customer"), Principal()).columns
    assert G.scrubbed("bad value 'secret' for :who") == "bad value '?' for :who"
