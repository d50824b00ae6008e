"""Point-in-time universes: who may be traded at each scheduled time, with the reason for each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions.core import FINER, by_symbol, ms, seconds


@dataclass(frozen=True)
class Rules:
    """Filters of the universe; None leaves one out. Windows are durations."""

    exclude: tuple[str, ...] = ()
    quote_asset: str = "USDT"
    margin_asset: str = "USDT"
    use_contracts: bool = True
    trading_only: bool = True
    min_age_days: int = 0
    min_history_bars: int | None = None
    volume_window: str = "3d"
    min_quote_volume: float | None = None
    missing_window: str = "3d"
    max_missing_ratio: float | None = None


def running_history(bars: DataFrame) -> DataFrame:
    """U1. Per symbol and close: complete bars so far, first open, cumulative quote volume of complete bars."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("is_complete").cast("long")
    return bars.select(
        "symbol", "close_time", F.sum(whole).over(w).alias("history_bars"), F.min("open_time").over(w).alias("first_bar_open"),
        F.sum(F.when(F.col("is_complete"), F.col("quote_volume")).otherwise(0.0)).over(w).alias("cumulative_quote"),
    )


def reason(r: Rules) -> Column:
    """U5. The first rule that fails, in a fixed order, or ELIGIBLE."""
    t, listed = F.col("timestamp"), F.col("listing_time")
    steps: list[tuple[Column, str]] = [(F.col("symbol").isin(*r.exclude) if r.exclude else F.lit(False), "EXPLICITLY_EXCLUDED")]
    if r.use_contracts:
        steps += [
            (F.col("snapshot_time").isNull(), "NO_CONTRACT_SNAPSHOT"),
            (F.upper("contract_type") != "PERPETUAL", "NOT_PERPETUAL"),
            (F.col("quote_asset") != r.quote_asset, "WRONG_QUOTE_ASSET"),
            (F.col("margin_asset") != r.margin_asset, "WRONG_MARGIN_ASSET"),
        ]
    steps += [(listed.isNull() | (listed > t), "NOT_LISTED"), (F.col("delivery_time").isNotNull() & (F.col("delivery_time") <= t), "DELISTED")]
    if r.trading_only and r.use_contracts:
        steps.append((F.col("status") != "TRADING", "NOT_TRADING"))
    steps.append((F.col("listing_age_days").isNull() | (F.col("listing_age_days") < r.min_age_days), "WARMUP"))
    if r.min_history_bars is not None:
        steps.append((F.col("history_bars") < r.min_history_bars, "INSUFFICIENT_HISTORY"))
    if r.max_missing_ratio is not None:
        steps.append((F.col("missing_ratio") > r.max_missing_ratio, "MISSING_DATA"))
    if r.min_quote_volume is not None:
        steps.append((F.col("rolling_quote_volume") < r.min_quote_volume, "ILLIQUID"))
    out = F.when(steps[0][0], steps[0][1])
    for test, name in steps[1:]:
        out = out.when(test, name)
    return out.otherwise("ELIGIBLE")


def build(bars: DataFrame, contracts: DataFrame, start_ms: int, end_ms: int, every: str, base: str, rules: Rules, version: str = "u1", offsets: DataFrame | None = None) -> DataFrame:
    """U6 (with U1-U5, U7). One row per scheduled time and symbol.

    Time is cut into slots that end at the scheduled times. Bars are summed by slot first; then one window in
    order of slots carries the latest snapshot and the running counts, and a row stands for the slots up to
    the symbol's next one, so no symbol is multiplied by the schedule before. A sum over (t - window, t]
    is that of whole slots and of the late part of the slot before them.
    The windows move with the schedule, also where bars have stopped. ``offsets`` (symbol,
    history_bars_offset, prior_first_bar_open) adds what stands before the range that is read.
    """
    step = seconds(every) * 1000
    if start_ms % step:
        raise ValueError("the schedule's start isn't aligned to its interval")
    count = -(-(end_ms - start_ms) // step)
    facts = ("snapshot_time", "contract_type", "status", "quote_asset", "margin_asset", "onboard_time", "delivery_time")
    spans = {name: divmod(seconds(width) * 1000, step) for name, width in (("quote", rules.volume_window), ("whole", rules.missing_window))}
    lowest = -1 - max(whole for whole, _ in spans.values())  # all that is older than any window
    slot = lambda t: F.greatest(F.lit(lowest), F.least(F.lit(count), F.coalesce(F.ceil((t - start_ms) / step), F.lit(lowest)))).cast("long")
    close = ms("close_time")
    own = bars.select("symbol", slot(close).alias("k"), close.alias("_t"), ms("open_time").alias("open_ms"), F.col("is_complete").cast("long").alias("whole"), F.when(F.col("is_complete"), F.col("quote_volume")).otherwise(0.0).alias("quote"))
    late = {name: F.sum(F.when(F.col("k") * step + start_ms - F.col("_t") < part, F.col(name))).alias(f"{name}_late") for name, (_, part) in spans.items()}
    sums = own.groupBy("symbol", "k").agg(F.min("open_ms").alias("open_ms"), *(F.sum(name).alias(name) for name in spans), *late.values())
    seen = contracts.select("symbol", slot(ms("snapshot_time")).alias("k"), F.lit(0).alias("side"), F.struct(*facts).alias("c"))
    # Wide rows that are sorted twice in a task: more and smaller tasks than other shuffles have.
    tasks = FINER * int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sums.withColumn("side", F.lit(1)).unionByName(seen, allowMissingColumns=True).repartition(tasks, "symbol")
    ordered = Window.partitionBy("symbol").orderBy("k", "side", "c.snapshot_time")
    past = ordered.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({
        "s": F.last("c", ignorenulls=True).over(past), "history_bars": F.sum("whole").over(past), "first_ms": F.min("open_ms").over(past), "_first": F.first("k").over(past), "_next": F.lead("k").over(ordered),
    })
    if not rules.use_contracts:
        both = both.withColumn("_barred", F.max("side").over(Window.partitionBy("symbol"))).where("_barred = 1")
    # The last row of a slot has all of it: what is known then, and the slot's sums.
    k, first = F.col("k"), F.col("k") == F.col("_first")
    ends = both.where(F.col("_next").isNull() | (F.col("_next") > k)).where(first | (k < count))
    until = F.least(F.coalesce("_next", F.lit(count)), F.lit(count)) - 1
    targets = F.filter(F.sequence(F.when(first, F.least(k, F.lit(0))).otherwise(k), until), lambda x: ((x >= 0) & (x < count)) | (x == k))
    known = lambda c: F.when(F.col("at") >= k, F.col(c)).alias(c)
    parts = [c for name in spans for c in (name, f"{name}_late")]
    met = ends.withColumn("at", F.explode(targets)).select("symbol", "at", *map(known, ("s", "history_bars", "first_ms")), *(F.when((F.col("at") == k) & (k > lowest), F.col(c)).alias(c) for c in parts))
    near = Window.partitionBy("symbol").orderBy("at")

    def summed(name: str) -> Column:
        slots, part = spans[name]
        out = F.lit(0.0 if name == "quote" else 0)
        if slots:
            out = out + F.coalesce(F.sum(name).over(near.rangeBetween(1 - slots, 0)), F.lit(0))
        if part:
            out = out + F.coalesce(F.sum(f"{name}_late").over(near.rangeBetween(-slots, -slots)), F.lit(0))
        return out

    met = met.withColumns({"_quote": summed("quote"), "_whole": summed("whole")}).where((F.col("at") >= 0) & (F.col("at") < count))
    expected = seconds(rules.missing_window) // seconds(base)
    panel = met.select(
        "symbol", (F.col("at") * step + start_ms).alias("t"), "s", F.coalesce("history_bars", F.lit(0)).alias("history_bars"), "first_ms", F.col("_quote").alias("rolling_quote_volume"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_whole") / F.lit(float(expected)))).alias("missing_ratio"),
    )
    if offsets is not None:
        panel = panel.join(offsets, "symbol", "left").withColumns({"history_bars": F.col("history_bars") + F.coalesce("history_bars_offset", F.lit(0)), "first_ms": F.coalesce(ms("prior_first_bar_open"), "first_ms")})
    panel = panel.select(F.timestamp_millis("t").alias("timestamp"), "symbol", "history_bars", "rolling_quote_volume", "missing_ratio", F.timestamp_millis("first_ms").alias("first_bar_open"), "s.*")
    panel = panel.withColumn("listing_time", F.coalesce("onboard_time", "first_bar_open"))
    panel = panel.withColumn("listing_age_days", ((ms("timestamp") - ms("listing_time")) / 86_400_000).cast("long"))
    coded = panel.withColumn("reason_code", reason(rules))
    return coded.select(
        "timestamp", "symbol", (F.col("reason_code") == "ELIGIBLE").alias("is_eligible"), "reason_code", "listing_age_days", "history_bars", "rolling_quote_volume",
        "missing_ratio", F.col("status").alias("contract_status"), F.lit(version).alias("universe_version"),
    )


def liquid(hours: DataFrame, grid: DataFrame, min_age_days: int, min_bars: int, top: int, window: str = "24h") -> DataFrame:
    """U8. At each time of ``grid``: listed long enough, bars enough in the window, largest quote volume first."""
    step = seconds(window) * 1000
    times = grid.select(ms("timestamp").alias("t")).distinct()
    # Each hour counts for the scheduled times of its window alone: an equi-join on the window's slot.
    own = hours.select("symbol", ms("available_at").alias("at"), "minute_count", "quote_volume", ms("hour").alias("h"))
    first = own.groupBy("symbol").agg(F.min("h").alias("first"))
    slots = times.select("t", F.explode(F.array(F.floor((F.col("t") - 1) / step), F.floor((F.col("t") - step) / step))).alias("slot")).distinct()
    near = own.withColumn("slot", F.floor((F.col("at") - 1) / step)).join(slots, "slot").where("at > t - %d and at <= t" % step)
    sums = near.groupBy("t", "symbol").agg(F.sum("minute_count").alias("bars"), F.sum("quote_volume").alias("volume"))
    good = sums.join(first, "symbol").where(F.col("first") <= F.col("t") - min_age_days * 86_400_000).where(F.col("bars") >= min_bars)
    ranked = good.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("volume"), "symbol")))
    return ranked.where(F.col("place") <= top).select(F.timestamp_millis("t").alias("timestamp"), "symbol", "bars", "volume", "place")
