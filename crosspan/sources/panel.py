"""Panels derived from the event, order and customer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import FINER, seconds


def utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(events: DataFrame, symbol: Column, interval: str, complete_trades: int = 1, version: str = "events-v1", in_order: bool = False) -> DataFrame:
    """OHLCV bars of ``value`` per symbol and left-closed interval; empty intervals have no bar.

    ``in_order``: values are added up by ``event_id``, the order in which the table has them and SQL on one thread adds
    them, so that the last bits of ``quote_volume`` and ``volume`` don't depend on how events are dealt to tasks; for
    bars of few events, since a bar's are held together.
    """
    step = seconds(interval) * 1000
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    source = events.where("ts is not null and value is not null").select(symbol.alias("symbol"), (t - t % step).alias("t"), F.struct("ts", "event_id").alias("at"), "value", (F.col("event_id") % 2 == 0).alias("taker"))
    taker = F.sum(F.when(F.col("taker"), F.col("value")).otherwise(0.0))
    total = F.sum("value")
    if in_order:
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("at.event_id", "value"))), F.lit(0.0), lambda sum_, e: sum_ + e["value"])
    out = source.groupBy("symbol", "t").agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"),
        (total / 2).alias("volume"), total.alias("quote_volume"), F.count("*").alias("trades"),
        (taker / 2).alias("taker_buy_volume"), taker.alias("taker_buy_quote_volume"), (F.count("*") >= complete_trades).alias("is_complete"),
    )
    return out.select(
        F.timestamp_millis("t").alias("open_time"), F.timestamp_millis(F.col("t") + step).alias("close_time"), "symbol", F.lit(interval).alias("interval"),
        "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume", "is_complete",
        F.lit("events").alias("source"), F.lit("events").alias("source_object_id"), F.lit(version).alias("dataset_version"),
    )


def bars(spark: SparkSession, sf_dir: str, kind: str = "6h", in_order: bool = False) -> DataFrame:
    """6h, 1h: by event type (dense, gappy); 1d: by user (wide). ``in_order`` as in :func:`bars_of`."""
    events = table(spark, sf_dir, "events")
    if kind == "1d":
        return bars_of(events, F.col("user_id").cast("string"), "1d", in_order=in_order)
    return bars_of(events, F.col("event_type"), kind, {"6h": 10, "1h": 2}[kind], in_order=in_order)


def funding(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """A settlement for each event; its rate is the value's fraction about 0, in percent."""
    events = table(spark, sf_dir, "events").where("value is not null")
    symbol = F.col("user_id").cast("string") if by_user else F.col("event_type")
    return events.select(
        F.col("ts").cast("timestamp").alias("funding_time"), symbol.alias("symbol"), ((F.col("value") % 1 - 0.5) / 100).alias("funding_rate"),
        F.col("value").alias("mark_price"), "event_id", F.lit("events-v1").alias("dataset_version"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract snapshots, one per order: dates are moved into the events' month by day."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # Rows are sorted to be joined and again to be aggregated, both in the same tasks: more and smaller ones than others.
    tasks = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = orders.repartition(tasks, "o_custkey").join(customers, orders.o_custkey == customers.c_custkey)
    day = F.lit(1704067200000) + (F.unix_millis(F.col("o_orderdate").cast("timestamp")) / 86400000).cast("long") % 30 * 86400000
    return joined.groupBy("o_custkey", F.timestamp_millis(day).alias("snapshot_time")).agg(
        F.max_by(F.struct("o_orderstatus", "c_mktsegment", "o_orderkey"), "o_orderkey").alias("s")
    ).select(
        F.col("o_custkey").cast("string").alias("symbol"), "snapshot_time",
        F.when(F.col("s.o_orderkey") % 17 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contract_type"),
        F.when(F.col("s.o_orderstatus") == "P", "BREAK").otherwise("TRADING").alias("status"),
        F.when(F.col("s.c_mktsegment") == "MACHINERY", "BUSD").otherwise("USDT").alias("quote_asset"),
        F.when(F.col("s.c_mktsegment") == "FURNITURE", "COIN").otherwise("USDT").alias("margin_asset"),
        F.timestamp_millis(F.lit(1704067200000) - (F.col("s.o_orderkey") % 60) * 86400000 + 864000000).alias("onboard_time"),
        F.when(F.col("s.o_orderkey") % 23 == 0, F.timestamp_millis(F.lit(1704067200000 + 15 * 86400000))).alias("delivery_time"),
        F.lit("orders-v1").alias("dataset_version"),
    )
