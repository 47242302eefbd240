"""Panel inputs derived from the star-schema tables.

Suppliers or their nations stand in for listed entities, line items for daily
trading, orders for search interest and events for news.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.operators.alignment import (
    assemble_panel, daily_log_returns, weekly_interest, weekly_returns)
from crosspanel.operators.features import FEATURES, build_features, rank_features
from crosspanel.session import bounded_like, stage

_STAGED: dict[tuple, DataFrame] = {}


def staged(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Staged table shared by the queries of one Spark application."""
    key = (spark.sparkContext.applicationId,) + key
    if key not in _STAGED:
        _STAGED[key] = stage(build(), key[1])
    return _STAGED[key]


def forget_staged() -> None:
    """Make the next query build its inputs afresh (the bench does)."""
    _STAGED.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def members(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """(ticker, keyword, sector, ordinal): the universe."""
    places = (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    if entity == "nation":
        return places.select(F.col("n_name").alias("ticker"), F.lower("n_name").alias("keyword"),
                             F.col("r_name").alias("sector"), F.col("n_nationkey").cast("long").alias("ordinal"))
    return (table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_name").alias("ticker"), F.lower("s_name").alias("keyword"),
                    F.col("r_name").alias("sector"), F.col("s_suppkey").alias("ordinal")))


def _entity_of_supplier(spark: SparkSession, sf: str, entity: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")
    if entity == "supplier":
        return supplier.select("s_suppkey", F.col("s_name").alias("ticker"))
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "ticker"))


def prices_daily(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """(ticker, date, close, adj_close, volume).

    Suppliers are summed per day before the dimension join, so only day totals
    meet it. A nation's line items meet it first: suppliers times days are about
    as many as line items, nations times days are few and summed before the
    exchange. Money is summed in whole cents (and hundredths of them), which is
    exact in any order.
    """
    price = F.col("l_extendedprice")
    sums = (F.sum(F.round(price * 100).cast("long")).alias("gross"),
            F.sum(F.round(price * (1 - F.col("l_discount")) * 10000).cast("long")).alias("net"),
            F.sum("l_quantity").alias("volume"))
    lines, entities = table(spark, sf, "lineitem"), _entity_of_supplier(spark, sf, entity)
    date, same = F.to_date("l_shipdate").alias("date"), F.col("l_suppkey") == F.col("s_suppkey")
    if entity == "supplier":
        daily = lines.groupBy("l_suppkey", date).agg(*sums).join(entities, same)
    else:
        daily = lines.join(entities, same).groupBy("ticker", date).agg(*sums)
    size = F.nullif("volume", F.lit(0.0))
    return daily.select("ticker", "date", (F.col("gross") / 100.0 / size).alias("close"),
                        (F.col("net") / 10000.0 / size).alias("adj_close"), "volume")


def sunday(date: Column) -> Column:
    return F.date_sub(date, F.dayofweek(date) - 1)


def _scaled_to_peak(counts: DataFrame) -> DataFrame:
    """Each entity's series, a row per week, as whole percent of its own peak."""
    peak = F.max("n").over(Window.partitionBy("ticker"))
    return counts.select("ticker", "date", F.round(F.lit(100.0) * F.col("n") / peak).alias("search_interest"))


def interest_weekly(spark: SparkSession, sf: str, entity: str = "nation",
                    orders_filter: Column | None = None) -> DataFrame:
    """(ticker, date, search_interest): Sunday weeks scaled to each entity's peak."""
    orders = table(spark, sf, "orders")
    if orders_filter is not None:
        orders = orders.where(orders_filter)
    orders = orders.select("o_orderkey", "o_custkey", sunday(F.to_date("o_orderdate")).alias("date"))
    if entity == "nation":
        customers = (table(spark, sf, "customer").join(
            table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_name").alias("ticker")))
        counts = (orders.groupBy("o_custkey", "date").agg(F.count(F.lit(1)).alias("n"))
                  .join(customers, F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("ticker", "date").agg(F.sum("n").alias("n")))
    else:
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
        counts = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                  .groupBy("l_suppkey", "date").agg(F.count(F.lit(1)).alias("n"))
                  .join(_entity_of_supplier(spark, sf, entity), F.col("l_suppkey") == F.col("s_suppkey"))
                  .select("ticker", "date", "n"))
    return _scaled_to_peak(counts)


def news_daily(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, date, tone, volume) per user and day."""
    return (table(spark, sf, "events")
            .groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"))
            .agg((F.avg("value") - 50).alias("tone"), F.count(F.lit(1)).alias("volume")))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """(batch, date, search_interest): one series per order priority."""
    return (table(spark, sf, "orders")
            .groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("batch"),
                     sunday(F.to_date("o_orderdate")).alias("date"))
            .agg(F.count(F.lit(1)).cast("double").alias("search_interest")))


def panel(spark: SparkSession, sf: str, entity: str = "nation", min_days: int = 1,
          min_fraction: float = 0.0) -> DataFrame:
    """The staged weekly panel; by default every week with at least one return."""
    def build() -> DataFrame:
        weekly = weekly_returns(daily_log_returns(prices_daily(spark, sf, entity)), min_days, min_fraction)
        interest = weekly_interest(interest_weekly(spark, sf, entity))
        return assemble_panel(weekly, members(spark, sf, entity), interest)
    return staged(spark, ("panel", sf, entity, min_days, min_fraction), build)


def features(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """Staged features rounded to 9 places, so that ties do not hang on a last bit."""
    def build() -> DataFrame:
        return build_features(panel(spark, sf, entity)).withColumns(
            {f: F.round(f, 9) for f in FEATURES})
    return staged(spark, ("features", sf, entity), build)


def ranked_features(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    return staged(spark, ("ranked", sf, entity), lambda: rank_features(features(spark, sf, entity)))


def predictions(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """Two raw features with their forward returns stand in for model output."""
    rows = features(spark, sf, entity)
    return bounded_like(rows.where(F.col("fwd_return").isNotNull()).select(
        "week_ending_friday", "ticker", "sector", "weekly_return", "fwd_return",
        F.col("asvi").alias("pred_a"), F.col("mom_12_1").alias("pred_b")), rows)
