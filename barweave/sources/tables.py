"""Bars, fills and other working tables derived from the stored source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import index_rows
from ..session import stage
from .bars import make_bars, number_bars

FILL_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
WHOLE = 20_000       # fills of one account that a task sorts at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def raw_bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """OHLCV bars of the event stream: symbol = event type, price = 100 + value."""
    return make_bars(event_ticks(spark, sf_dir), "event_type", "ts", 100 + F.col("value"), interval, tiebreak="event_id")


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """Numbered event bars (``rn`` and the total ``n`` per symbol)."""
    return number_bars(raw_bars(spark, sf_dir, interval), total="n")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered daily bars of order values: symbol = order priority."""
    o = table(spark, sf_dir, "orders")
    return number_bars(make_bars(o, "o_orderpriority", "o_orderdate", F.col("o_totalprice"), "1d", tiebreak="o_orderkey"), total="n")


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills: account = supplier, returns are sells."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("account"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey",
                     "l_quantity", "l_extendedprice", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"))


def fills(spark: SparkSession, sf_dir: str, whole: int = WHOLE) -> DataFrame:
    """Fills numbered per account.  An account of up to ``whole`` fills is sorted at once; the others are cut into
    buckets that follow the order: the day, then ranges of order keys (what comes later that day is the last bucket)."""
    f = raw_fills(spark, sf_dir)
    many = f.groupBy("account").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole)
    many = F.broadcast(stage(many.select(F.col("account").alias("_a"), F.lit(True).alias("_many"))))      # one row per ``whole`` fills at most
    f = f.join(many, F.col("account").eqNullSafe(F.col("_a")), "left").drop("_a")
    day = F.to_date("ts")
    keys = F.when(F.col("ts") == day, F.floor(F.col("l_orderkey") / 1_000_000)).otherwise(2**62)
    f = index_rows(f, ["account"], FILL_ORDER, [F.when(F.col("_many"), day), F.when(F.col("_many"), keys)]).drop("_many")
    return f.withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "qty": F.col("l_quantity")})


def cost_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    market = F.when(F.col("l_linestatus") == "F", "futures").when(F.col("l_discount") > 0.05, "equity_intraday").otherwise("equity_delivery")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("turnover"), market.alias("market_type"),
                     F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"))
