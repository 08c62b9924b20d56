"""Star-schema analytics: comparisons, shares, targets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import settled


def money(c: Column | str) -> Column:
    """Exact decimals summed, then shown as a double."""
    return F.sum(c).cast("double")


def total_by(fact: DataFrame, *keys: str, **measures: str) -> DataFrame:
    return fact.groupBy(*keys).agg(*(money(c).alias(n) for n, c in (measures or {"net_sales": "net"}).items()))


def year_over_year(fact: DataFrame, now: tuple[str, str], before: tuple[str, str], *keys: str) -> DataFrame:
    """Net of two half-open ranges side by side in one pass, and their ratio less one."""

    def within(r: tuple[str, str]) -> Column:
        return (F.col("order_date") >= F.lit(r[0]).cast("date")) & (F.col("order_date") < F.lit(r[1]).cast("date"))

    out = fact.where(within(now) | within(before)).groupBy(*keys).agg(money(F.when(within(now), F.col("net"))).alias("current_sales"), money(F.when(within(before), F.col("net"))).alias("previous_sales"))
    return out.withColumn("yoy", F.round(F.col("current_sales") / F.nullif(F.col("previous_sales"), F.lit(0.0)) - 1, 6))


def delta_contribution(yoy: DataFrame, key: str) -> DataFrame:
    """Each key's part in the overall change.  The total is one row, so its broadcast is bounded."""
    rows = yoy.select(key, (F.coalesce("current_sales", F.lit(0.0)) - F.coalesce("previous_sales", F.lit(0.0))).alias("raw_delta"))
    total = rows.agg(F.sum(F.col("raw_delta").cast("decimal(28,4)")).cast("double").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(key, F.round("raw_delta", 2).alias("delta"), F.round(F.col("raw_delta") / F.nullif(F.col("total"), F.lit(0.0)), 6).alias("contribution"))


def against_peers(yoy: DataFrame, key: str, gap: float = 0.2) -> DataFrame:
    """yoy of each key less the best of all others; flagged where it lags by gap or more.

    The best of the others needs only the two highest values, not a window over all rows.
    """
    top = yoy.agg(F.max_by(key, F.struct("yoy", key)).alias("leader"), F.slice(F.sort_array(F.collect_list("yoy"), asc=False), 1, 2).alias("two"))
    peers = F.when(F.col(key) == F.col("leader"), F.element_at("two", 2)).otherwise(F.element_at("two", 1))
    out = yoy.crossJoin(F.broadcast(top)).withColumn("best_other", peers)
    return out.select(key, "yoy", "best_other", F.coalesce(F.col("best_other") - F.col("yoy") >= gap, F.lit(False)).alias("anomalous"))


def achievement(actual: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides are aggregated to the same grain before they meet."""
    a = actual.groupBy(*keys).agg(money("net").alias("actual"))
    t = target.groupBy(*keys).agg(F.round(F.sum(F.col("target").cast("decimal(18,2)")), 2).cast("double").alias("target"))
    return t.join(a, keys, "left").select(*keys, "target", F.coalesce("actual", F.lit(0.0)).alias("actual"), F.round(F.coalesce("actual", F.lit(0.0)) / F.nullif(F.col("target"), F.lit(0.0)), 6).alias("achievement"))


def shares(totals: DataFrame, key: str, value: str) -> DataFrame:
    """Value of each key and its share of the whole; the whole is one row."""
    whole = totals.agg(F.sum(F.col(value).cast("decimal(28,4)")).cast("double").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select(key, value, F.round(F.col(value) / F.nullif(F.col("whole"), F.lit(0.0)), 6).alias("share"))


def report(fact: DataFrame, cutoff: str, *keys: str) -> DataFrame:
    """Five measures of what was ordered up to the cutoff, that day included."""
    rows = fact.where(F.col("order_date") <= F.lit(cutoff).cast("date"))
    return rows.groupBy(*keys).agg(money("net").alias("net"), money("gross").alias("gross"), money("discount").alias("discount"), money("returned").alias("returned"), F.count("*").alias("n_lines"))


def weeks_below(stock: DataFrame, *keys: str) -> DataFrame:
    return stock.groupBy(*keys).agg(F.count(F.when(F.col("available") < F.col("safety"), 1)).alias("weeks_below"), F.count("*").alias("weeks"))


def nearest_rank(df: DataFrame, value: str, fraction: float, *keys: str) -> DataFrame:
    """Order statistic without interpolation: the ceil(fraction * n)-th value."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})").alias("value"), F.count(value).alias("n"))


def even_sample(df: DataFrame, order: str, count: int) -> DataFrame:
    """Rows at places floor(i * n / count) of the order: a sampling operator, at most count rows.

    The places are found from counts a range partition, so no single task sorts or numbers all rows.
    """
    keyed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    keyed = settled(keyed)  # range boundaries are sampled; both uses must see the same
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("_before", F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    total = sizes.agg(F.sum("size").alias("_n"))
    at = keyed.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part").crossJoin(F.broadcast(total)).withColumn("_at", F.col("_before") + F.col("_place"))
    # place p is chosen if floor(i * n / count) = p for some i: i is ceil(p * count / n)
    i = F.ceil(F.col("_at") * count / F.col("_n"))
    return at.where((i < count) & (F.floor(i * F.col("_n") / count) == F.col("_at"))).drop("_part", "_place", "_before", "_n", "_at")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side without a partner on the other, and the side; empty if both hold the same rows as often."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
