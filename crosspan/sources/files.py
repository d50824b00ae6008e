"""Scans, parsers of raw payloads, and publishing of bar tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import is_finite, seconds

KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume")
BARS = "open_time timestamp, close_time timestamp, symbol string, interval string, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_volume double, taker_buy_quote_volume double, is_complete boolean, source string, source_object_id string, dataset_version string"
FUNDING = "funding_time timestamp, symbol string, funding_rate double, mark_price double, funding_interval_hours int, source_object_id string, dataset_version string"
MARKS = "open_time timestamp, close_time timestamp, symbol string, interval string, open double, high double, low double, close double, is_complete boolean, source string, source_object_id string, dataset_version string"
CONTRACTS = "snapshot_time timestamp, symbol string, contract_type string, status string, base_asset string, quote_asset string, margin_asset string, onboard_time timestamp, delivery_time timestamp, price_tick double, quantity_step double, min_quantity double, min_notional double, dataset_version string"
EPOCH_MS = (0, 4_102_444_800_000)


def names(schema: str) -> list[str]:
    """The columns of a schema string."""
    return [part.split(" ")[0] for part in schema.split(", ")]


def scan(spark: SparkSession, root: str, schema: str, version: str, time: str, start: Column, end: Column, interval: str | None = None, columns: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """IO1-IO4. A version's rows with start <= time < end. Filters stand on raw columns, so files,
    row groups and columns that aren't needed aren't read."""
    df = spark.read.schema(schema).parquet(root).where((F.col("dataset_version") == version) & (F.col(time) >= start) & (F.col(time) < end))
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return df.select(*columns) if columns else df


def finite(c: Column) -> Column:
    """IO10. A finite double, else null."""
    v = c.try_cast("double")
    return F.when(is_finite(v), v)


def integral(c: Column) -> Column:
    return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("long"))


def epoch_ms(c: Column) -> Column:
    v = integral(c)
    return F.when(v.between(*EPOCH_MS), F.timestamp_millis(v))


def printable(c: Column) -> Column:
    t = F.trim(c)
    return F.when((t != "") & ~t.rlike(r"[\p{Cc}]"), t)


def klines(cells: Column, df: DataFrame, symbol: Column, interval: str, source: str, version: str, retrieved: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of rows whose ``cells`` are the kline's strings by position.

    The source's close is inclusive, so close_time is one millisecond later. Archived bars are
    complete; others if they had closed when they were retrieved.
    """
    c = lambda name: F.get(F.col("_c"), KLINE.index(name))
    step = seconds(interval) * 1000
    closed = integral(c("close_time")) + 1
    complete = F.lit(True) if retrieved is None else F.timestamp_millis(closed) <= retrieved
    parsed = df.withColumn("_c", cells).select(
        epoch_ms(c("open_time")).alias("open_time"), F.timestamp_millis(closed).alias("close_time"), printable(symbol).alias("symbol"), F.lit(interval).alias("interval"),
        *(finite(c(x)).alias(x) for x in ("open", "high", "low", "close", "volume", "quote_volume")), integral(c("trades")).alias("trades"), *(finite(c(x)).alias(x) for x in ("taker_buy_volume", "taker_buy_quote_volume")),
        complete.alias("is_complete"), F.lit(source).alias("source"), F.lit(source).alias("source_object_id"), F.lit(version).alias("dataset_version"), F.to_json("_c").alias("_raw"), (closed - integral(c("open_time")) == step).alias("_step"),
    )
    bad = ~F.coalesce(F.col("_step"), F.lit(False))
    for x in ("open_time", "symbol", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume"):
        bad = bad | F.col(x).isNull()
    return parsed.where(~bad).drop("_raw", "_step"), parsed.where(bad).select("symbol", "_raw")


#: Names that a header of kline archives may hold, without case, spaces and underscores.
KLINE_NAMES = (*(x.replace("_", "") for x in KLINE), "quoteassetvolume", "numberoftrades", "count", "takerbuybaseassetvolume", "takerbuyquoteassetvolume", "takerbuybasevolume", "ignore")


def csv_klines(lines: DataFrame, interval: str, version: str, value: str = "value", symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """IO6. Lines of archive CSV with (symbol, value).

    Lines of a text scan have no order, so a header is told by what it is: its first cell isn't a
    number, and a cell is the name of a column. Empty lines hold nothing. Any other line without a
    readable time is damaged, and a reject.
    """
    cells = F.split(F.col(value), ",")
    name = lambda c: F.lower(F.regexp_replace(c, r"[\s_\"]", ""))
    header = ~F.coalesce(F.get(cells, F.lit(0)).rlike(r"^\s*[0-9]"), F.lit(False)) & F.exists(cells, lambda c: name(c).isin(*KLINE_NAMES))
    body = lines.where(F.trim(F.col(value)) != "").where(~header)
    return klines(cells, body, F.col(symbol), interval, "archive", version)


def parsed_pages(payloads: DataFrame, value: str, kind: str, items: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``payloads`` with ``_items``, the array that each holds, and those that hold none (null or no such JSON)."""
    read = F.from_json(value, kind)
    df = payloads.withColumn("_items", read[items] if items else read)
    return df.where("_items is not null"), df.where("_items is null")


def json_klines(payloads: DataFrame, interval: str, version: str, retrieved: Column, value: str = "value", symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """IO7. Payloads that are arrays of arrays of strings; one that isn't is a reject as a whole."""
    pages, broken = parsed_pages(payloads, value, "array<array<string>>")
    good, bad = klines(F.col("_row"), pages.select(F.col(symbol), F.explode("_items").alias("_row")), F.col(symbol), interval, "rest", version, retrieved)
    return good, bad.unionByName(broken.select(printable(F.col(symbol)).alias("symbol"), F.col(value).alias("_raw")))


FUNDING_CELLS = ("symbol", "fundingTime", "calc_time", "fundingRate", "last_funding_rate", "markPrice")


def funding_table(cells: DataFrame, hours: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(settlements, rejects) of rows whose ``FUNDING_CELLS`` are strings; columns that are absent are null.

    A row without a readable time, symbol or rate is a reject, and so is one whose mark isn't a number.
    """
    c = lambda name: F.col(name) if name in cells.columns else F.lit(None).cast("string")
    out = cells.select(
        epoch_ms(F.coalesce(c("fundingTime"), c("calc_time"))).alias("funding_time"), F.upper(printable(c("symbol"))).alias("symbol"), finite(F.coalesce(c("fundingRate"), c("last_funding_rate"))).alias("funding_rate"),
        finite(c("markPrice")).alias("mark_price"), F.lit("raw").alias("source_object_id"), F.lit(version).alias("dataset_version"), F.to_json(F.struct(*(c(x).alias(x) for x in FUNDING_CELLS))).alias("_raw"), (c("markPrice").isNotNull() & (F.trim(c("markPrice")) != "")).alias("_marked"),
    )
    bad = F.col("funding_time").isNull() | F.col("symbol").isNull() | F.col("funding_rate").isNull() | (F.col("_marked") & F.col("mark_price").isNull())
    good = out.where(~bad).drop("_raw", "_marked").join(hours.select(F.upper("symbol").alias("symbol"), "funding_interval_hours"), "symbol", "left")
    return good, out.where(bad).select("symbol", "_raw")


def funding_rows(payloads: DataFrame, hours: DataFrame, version: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """IO8. (settlements, rejects) of objects in either dialect (fundingTime / calc_time, fundingRate /
    last_funding_rate), with the interval's hours by symbol. A payload that isn't an array of objects is a reject."""
    kind = f"array<struct<{','.join(f'{x}:string' for x in FUNDING_CELLS)}>>"
    pages, broken = parsed_pages(payloads, value, kind)
    good, bad = funding_table(pages.select(F.explode("_items").alias("r")).select("r.*"), hours, version)
    return good, bad.unionByName(broken.select(F.lit(None).cast("string").alias("symbol"), F.col(value).alias("_raw")))


def csv_funding(rows: DataFrame, hours: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """IO8. (settlements, rejects) of archive CSV read with its header; files of one dialect at a time."""
    return funding_table(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns if c in FUNDING_CELLS)), hours, version)


def contract_rows(payloads: DataFrame, version: str, value: str = "value", snapshot: str = "snapshot_time") -> tuple[DataFrame, DataFrame]:
    """IO9. (contracts, rejects) of exchange metadata: one row per symbol, sizes from its nested filters.

    A symbol without a price tick or a quantity step above 0 is a reject, and so is a payload without
    a list of symbols.
    """
    kind = "struct<symbols:array<struct<symbol:string,contractType:string,status:string,baseAsset:string,quoteAsset:string,marginAsset:string,onboardDate:string,deliveryDate:string,filters:array<struct<filterType:string,tickSize:string,stepSize:string,minQty:string,notional:string>>>>>"
    pages, broken = parsed_pages(payloads, value, kind, "symbols")
    s = pages.select(F.col(snapshot), F.explode("_items").alias("s")).select(snapshot, F.to_json("s").alias("_raw"), "s.*")
    pick = lambda name, field: finite(F.get(F.filter("filters", lambda f: f["filterType"] == name), F.lit(0))[field])
    out = s.select(
        F.col(snapshot).alias("snapshot_time"), F.upper(printable(F.col("symbol"))).alias("symbol"), F.upper("contractType").alias("contract_type"), F.upper("status").alias("status"), F.upper("baseAsset").alias("base_asset"), F.upper("quoteAsset").alias("quote_asset"), F.upper("marginAsset").alias("margin_asset"),
        epoch_ms(F.col("onboardDate")).alias("onboard_time"), epoch_ms(F.col("deliveryDate")).alias("delivery_time"), pick("PRICE_FILTER", "tickSize").alias("price_tick"), pick("LOT_SIZE", "stepSize").alias("quantity_step"), pick("LOT_SIZE", "minQty").alias("min_quantity"), pick("MIN_NOTIONAL", "notional").alias("min_notional"), F.lit(version).alias("dataset_version"), "_raw",
    )
    good = F.coalesce(F.col("symbol").isNotNull() & (F.col("price_tick") > 0) & (F.col("quantity_step") > 0), F.lit(False))
    unread = broken.select(F.col(snapshot).alias("snapshot_time"), F.lit(None).cast("string").alias("symbol"), F.col(value).alias("_raw"))
    return out.where(good).drop("_raw"), out.where(~good).select("snapshot_time", "symbol", "_raw").unionByName(unread)


def publish(bars: DataFrame, path: str) -> None:
    """IO11. Sorted zstd Parquet by interval, year and month; an existing path is an error.

    A month is dealt to several tasks by symbol, so no partition is one task's alone.
    """
    dated = bars.withColumns({"year": F.year("open_time"), "month": F.month("open_time")})
    dealt = dated.repartition("interval", "year", "month", F.pmod(F.xxhash64("symbol"), F.lit(8)))
    dealt.sortWithinPartitions("interval", "year", "month", "symbol", "open_time").write.partitionBy("interval", "year", "month").option("compression", "zstd").mode("error").parquet(path)


UNTRACKED = "spark.sql.hive.manageFilesourcePartitions"


@contextmanager
def passing_table(spark: SparkSession) -> Iterator[str]:
    """The name of a table that is gone from the catalog afterwards; its files stay. Partitions are found
    in the folders, so that what was read through the table doesn't need it any more."""
    name, before = f"passing_{uuid.uuid4().hex}", spark.conf.get(UNTRACKED)
    spark.conf.set(UNTRACKED, "false")
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.set(UNTRACKED, before)


def publish_by_symbol(bars: DataFrame, path: str, buckets: int) -> None:
    """IO11. As :func:`publish`, but within each month in ``buckets`` files by hash of the symbol, sorted by
    symbol and time; a folder that isn't empty is an error.

    What :func:`scan_by_symbol` reads of it is partitioned by symbol already: windows, joins and groups by
    symbol move no row. A bucket of all months is one task's, so choose as many as give each task what
    it can sort, a few hundred MB, and no more: there are ``buckets`` files a month.
    """
    dated = bars.withColumns({"year": F.year("open_time"), "month": F.month("open_time")})
    dealt = dated.repartition("interval", "year", "month", F.pmod(F.hash("symbol"), F.lit(buckets)))
    with passing_table(bars.sparkSession) as name:
        dealt.write.partitionBy("interval", "year", "month").bucketBy(buckets, "symbol").sortBy("symbol", "open_time").option("compression", "zstd").option("path", path).mode("error").saveAsTable(name, format="parquet")


def scan_by_symbol(spark: SparkSession, path: str, buckets: int, version: str, start: Column, end: Column, interval: str, columns: list[str] | None = None, schema: str = BARS) -> DataFrame:
    """IO1. A version's bars with start <= open_time < end of what :func:`publish_by_symbol` wrote with
    as many ``buckets``, partitioned by symbol. ``columns`` must hold the symbol to keep this.

    Whole months outside are left out by their folders, others by the statistics of their row groups.
    """
    fields = ", ".join(f"`{n}` {kind}" for n, kind in (part.split(" ") for part in schema.split(", ")))
    with passing_table(spark) as name:
        spark.sql(f"CREATE TABLE {name} ({fields}, `year` int, `month` int) USING parquet PARTITIONED BY (`interval`, `year`, `month`) CLUSTERED BY (symbol) SORTED BY (symbol, open_time) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        df = spark.table(name)
        month = F.col("year") * 12 + F.col("month")
        df = df.where((F.col("dataset_version") == version) & (F.col("interval") == interval) & (F.col("open_time") >= start) & (F.col("open_time") < end))
        df = df.where((month >= F.year(start) * 12 + F.month(start)) & (month <= F.year(end) * 12 + F.month(end)))
        return df.select(*(columns or names(schema)))


def manifest(bars: DataFrame) -> DataFrame:
    """IO12. By partition: rows, first and last time, symbols."""
    return bars.groupBy("dataset_version", "interval", F.year("open_time").alias("year"), F.month("open_time").alias("month")).agg(F.count("*").alias("row_count"), F.min("open_time").alias("min_time"), F.max("open_time").alias("max_time"), F.count_distinct("symbol").alias("symbols"))


def conformed(df: DataFrame, schema: list[tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """IO13. Columns in order and cast, and one row with the nulls of those that are required."""
    out = df.select(*(F.col(name).cast(kind).alias(name) for name, kind, _ in schema))
    return out, out.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name, _, required in schema if required))
