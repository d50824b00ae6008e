"""Operators on the time axis: segments, resampling, clocks, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspan.functions.core import by_symbol, ms, seconds


def segments(bars: DataFrame, interval: str, valid: Column | None = None, name: str = "segment") -> DataFrame:
    """T1. A running id that moves on at a gap, and before and after every invalid row."""
    w, step = by_symbol(), seconds(interval) * 1000
    ok = F.coalesce(F.col("is_complete") if valid is None else valid, F.lit(False))
    flagged = bars.withColumn("_ok", ok)
    before = F.lag("_ok").over(w)
    moves = F.lag("open_time").over(w).isNull() | (ms("open_time") - ms(F.lag("open_time").over(w)) != step) | ~F.col("_ok") | ~F.coalesce(before, F.lit(False))
    return flagged.withColumn("_new", moves.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_ok", "_new")


def resample(bars: DataFrame, base: str, interval: str, volumes: bool = True) -> DataFrame:
    """T2, T3. Bars of a longer interval, label left; complete only if every base bar is there and complete.

    Gaps stay gaps. Weeks begin on Monday.
    """
    step, expected = seconds(interval) * 1000, seconds(interval) // seconds(base)
    shift = 4 * 86_400_000 if seconds(interval) % 604800 == 0 else 0
    t = ms("open_time")
    bucket = t - (t - shift) % step
    aggs = [F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close")]
    if volumes:
        aggs += [F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume")]
    complete = F.bool_and("is_complete") & (F.count("*") == expected) & (F.count_distinct("open_time") == expected) & (ms(F.min("open_time")) == F.first("t"))
    out = bars.withColumn("t", bucket).groupBy("symbol", "t").agg(*aggs, complete.alias("is_complete"), F.count("*").alias("bar_count"))
    return out.withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + step), "interval": F.lit(interval)}).drop("t")


def hour_bars(bars: DataFrame) -> DataFrame:
    """T4. Last close, bar count and quote volume by hour, available at the hour's end."""
    hour = F.date_trunc("hour", "open_time")
    out = bars.groupBy("symbol", hour.alias("hour")).agg(F.max_by("close", "open_time").alias("close"), F.count("*").alias("minute_count"), F.sum("quote_volume").alias("quote_volume"))
    return out.withColumn("available_at", F.col("hour") + F.expr("interval 1 hour"))


def schedule(spark: SparkSession, start_ms: int, end_ms: int, interval: str) -> DataFrame:
    """T5. Timestamps from ``start`` to before ``end``; the start must be a multiple of the interval."""
    step = seconds(interval) * 1000
    if start_ms % step:
        raise ValueError("the schedule's start isn't aligned to its interval")
    return spark.range(start_ms, end_ms, step).select(F.timestamp_millis("id").alias("timestamp"))


def thin(df: DataFrame, interval: str, column: str = "timestamp") -> DataFrame:
    """T6. Rows whose time is a multiple of the interval."""
    return df.where(ms(column) % (seconds(interval) * 1000) == 0)


def market_clock(bars: DataFrame) -> DataFrame:
    """T7. One row per open time with its close time; ``consistent`` says if all bars agree on it."""
    return bars.groupBy("open_time").agg(F.min("close_time").alias("close_time"), (F.min("close_time") == F.max("close_time")).alias("consistent"), F.count("*").alias("bars"))


def fills(signals: DataFrame, bars: DataFrame, interval: str, delay_bars: int = 1) -> DataFrame:
    """T8. Signals at the bar that opens ``delay_bars`` later; without such a bar they drop out."""
    shift = (delay_bars - 1) * seconds(interval) * 1000
    timed = signals.withColumn("fill_time", F.timestamp_millis(ms("timestamp") + shift))
    opens = bars.where("is_complete").select(F.col("open_time").alias("fill_time"), "symbol", F.col("open").alias("fill_price"))
    return timed.join(opens, ["fill_time", "symbol"])


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: list[str], strict: bool = False, prefix: str = "", every: str | None = None) -> DataFrame:
    """J2. Each left row with the right row of the latest time not after it (``strict``: before it).

    Both sides go to one window by key: one shuffle and no pairs. The right row travels as a struct,
    so nulls of the latest row aren't filled from older ones. ``every``: a key's rows go to windows of
    this length of time, so that one key can keep many tasks at work; the last right row before a
    stretch is carried in at its beginning, from one row for each key and stretch.
    """
    values = [c for c in right.columns if c not in keys]
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_r"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    both, named = a.unionByName(b), [f"_k{i}" for i in range(len(keys))]
    if every is not None:
        step = seconds(every) * 1000
        both = both.withColumn("_slot", F.floor(ms("_t") / step))
        ends = both.groupBy(*named, "_slot").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_end"))
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*named).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.withColumn("_r", before).where("_r is not null").select(*named, F.timestamp_millis(F.col("_slot") * step).alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(dict(a.dtypes)["_l"]).alias("_l"), "_r", "_slot")
        both, named = both.unionByName(carried), [*named, "_slot"]
    w = Window.partitionBy(*named).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return both.select("_l.*", *(F.col(f"_m.{c}").alias(prefix + c) for c in values))


def interval_join(events: DataFrame, bars: DataFrame, event_time: str, interval: str) -> DataFrame:
    """J5. Events with the bar in whose (open_time, close_time] they fall: an equi-join on the bar's open."""
    step = seconds(interval) * 1000
    opened = F.timestamp_millis(ms(event_time) - 1 - (ms(event_time) - 1) % step)
    return events.withColumn("open_time", opened).join(bars, ["symbol", "open_time"])


def carried_close(grid: DataFrame, bars: DataFrame, on: str = "timestamp", strict: bool = False) -> DataFrame:
    """T9. The last close at or before (``strict``: before) each time of the grid."""
    marks = bars.where("close is not null").select("symbol", "close_time", F.col("close").alias("carried_close"))
    return asof(grid, marks, on, "close_time", ["symbol"], strict).drop("close_time")


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """S3. The first n rows of an order."""
    return df.orderBy(*order).limit(n)
