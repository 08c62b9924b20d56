"""Table scans: the star schema over the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import bounded

MONEY, RATE = "decimal(12,2)", "decimal(5,2)"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that one task sorts.
PART = 250_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A large table dealt out by key in parts of about PART rows, which joins and windows by the key keep: what a task sorts does not grow with the table.  One of up to four parts stays as it is."""
    n = df.count()
    return df.repartition(-(-n // PART), key) if n > 4 * PART else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table of fewer files than cores, dealt out anew by key so that all cores work; a table of more files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_key, region_key, region_name: one row a nation; the 25 nations and 5 regions are fixed, so broadcast."""
    n, r = raw(spark, sf_dir, "nation"), raw(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nation_key"), F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = raw(spark, sf_dir, "customer"), regions(spark, sf_dir)
    return c.join(F.broadcast(n), c.c_nationkey == n.nation_key).select(F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("customer_name"), "region_key", "region_name", F.col("c_mktsegment").alias("channel"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("line"), F.col("p_type").alias("category"), F.col("p_retailprice").cast(MONEY).alias("list_price"))


def amounts() -> dict[str, Column]:
    """gross, discount, returned and net of an order line; exact decimals, net = gross - discount - returned."""
    price, tax, off = F.col("l_extendedprice").cast(MONEY), F.col("l_tax").cast(RATE), F.col("l_discount").cast(RATE)
    gross, discount = price * (1 + tax), price * off
    kept = gross - discount
    back = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast("decimal(18,4)")
    return {"gross": gross, "discount": discount, "returned": F.when(back, kept).otherwise(zero), "net": F.when(back, zero).otherwise(kept)}


def sales(spark: SparkSession, sf_dir: str, *, start: str | None = None, end: str | None = None, dims: tuple[str, ...] = ("customer", "product")) -> DataFrame:
    """Order lines with their order's date and, of the dimensions asked for, the customer's region and channel, the product's line and category.

    A date range [start, end) is applied to orders before any join, so it reaches the Parquet scan.
    Orders and order lines meet on the order key; the dimensions are broadcast by Spark if they are
    small and shuffled if they are not.  An inner join is never dropped by the optimiser, so a report
    names the dimensions it reads; every key is taken to have its dimension row.
    """
    orders = raw(spark, sf_dir, "orders")
    if start:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    o = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), F.to_date("o_orderdate").alias("order_date"))
    placed = o.join(customers(spark, sf_dir).drop("customer_name"), "cust_key") if "customer" in dims else o
    li = dealt(raw(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_quantity").alias("quantity"), *(c.alias(n) for n, c in amounts().items()))
    lines = li.join(placed, "order_key")
    return lines.join(products(spark, sf_dir).select("part_key", "line", "category"), "part_key") if "product" in dims else lines


def targets(fact: DataFrame) -> DataFrame:
    """period_month, region_key, region_name, line, target: net of the same month a year before, and five percent more."""
    by_month = fact.groupBy(F.trunc("order_date", "month").alias("month"), "region_key", "region_name", "line").agg(F.sum("net").alias("net"))
    return by_month.select(F.add_months("month", 12).alias("period_month"), "region_key", "region_name", "line", F.round(F.col("net").cast("double") * 1.05, 2).alias("target"))


def inventory(fact: DataFrame, safety: float = 50.0) -> DataFrame:
    """week (a Monday), region, line, available and safety: a synthetic stock level, from what is ordered in a week."""
    return fact.groupBy(F.trunc("order_date", "week").alias("week"), "region_key", "region_name", "line").agg(F.sum("quantity").alias("available")).withColumn("safety", F.lit(safety))
