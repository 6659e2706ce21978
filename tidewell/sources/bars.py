"""Sources: daily bars, ticks and a lagged monthly series.

Bars are one row for an asset and a day, so a series has as many rows as days,
whatever the number of ticks behind it; windows over a series by asset are
therefore bounded by the calendar.  Ticks are aggregated with partial sums
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET = "market"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_ticks(ticks: DataFrame, keys: list[str], price: str, order: str) -> DataFrame:
    """open, high, low, close and volume of each key; ties of time are told apart by ``order``."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(price).alias("volume"),
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each order priority, and of all orders as MARKET."""
    orders = table(spark, sf_dir, "orders").select(
        F.explode(F.array(F.lit(MARKET), F.col("o_orderpriority"))).alias("asset_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        "o_totalprice",
        "o_orderkey",
    )
    return bars_from_ticks(orders, ["asset_id", "date"], "o_totalprice", "o_orderkey")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.lit(MARKET).alias("asset_id"), F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderkey"
    )
    return bars_from_ticks(orders, ["asset_id", "date"], "o_totalprice", "o_orderkey")


def complete_days(ticks: DataFrame, time: str, until: str) -> DataFrame:
    """Ticks of days that had ended at ``until``: the running day is no bar yet."""
    return ticks.where(F.col(time).cast("date") < F.lit(until).cast("date"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset_id"), F.col("ts").cast("date").alias("date"), "value", F.struct("ts", "event_id").alias("at")
    )
    return bars_from_ticks(events, ["asset_id", "date"], "value", "at")


def monthly_macro(spark: SparkSession, sf_dir: str, lag_days: int = 30) -> DataFrame:
    """Monthly totals with the day from which each is known: date, revenue, quantity, n_lines, available_after."""
    lines = table(spark, sf_dir, "lineitem")
    months = lines.groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return months.withColumn("available_after", F.date_add("date", lag_days))


def merge_rows(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a row of ``newer`` replaces the row of ``base`` with its keys."""
    both = base.join(newer.select(*keys).distinct(), keys, "left_anti")
    return both.unionByName(newer)
