"""Factors: causal values at a bar's close, null where their window is gapped or incomplete.

Families F (exact elapsed time over all bars of a symbol), G and K (within gap segments), E (user
expressions) and the recursive average R1 on which several of them stand.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions import rolling
from crosspan.functions.core import bars_in, by_symbol, is_finite, ms, ratio, seconds
from crosspan.functions.rolling import Windows
from crosspan.operators.timeaxis import segments, thin

SEGMENT = ("segment",)


# ------------------------------------------------------------------------------ the recursion R1


def exponential(bars: DataFrame, value: str, alpha: float, out: str, min_samples: int = 1, keys: tuple[str, ...] = ("symbol", "segment"), negligible: float = 1e-25) -> DataFrame:
    """R1. y = (1 - alpha) y_before + alpha x over ``keys`` in time, from the first non-null x.

    Null until ``min_samples`` values, and where x is null. The sum is taken over chunks so long that
    what reaches beyond the chunk before weighs less than ``negligible``: a row needs its chunk's
    weighted sum and the end of the chunk before. All windows share one shuffle by ``keys``.
    """
    decay = 1.0 - alpha
    if decay <= 0:
        return bars.withColumn(out, F.col(value))
    chunk = max(2, min(1 << 20, math.ceil(math.log(negligible) / math.log(decay))))
    w = Window.partitionBy(*keys).orderBy("open_time")
    x, power = F.col(value), lambda e: F.pow(F.lit(decay), e.cast("double"))
    b = bars.withColumn("_i", F.count(x).over(w) - 1)
    b = b.withColumns({"_c": F.floor(F.col("_i") / chunk), "_j": F.col("_i") % chunk})
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    scaled = F.sum(F.when(x.isNotNull(), weight * x * power(-F.col("_j")))).over(Window.partitionBy(*keys, "_c").orderBy("open_time"))
    b = b.withColumn("_local", F.when(x.isNotNull(), scaled * power(F.col("_j"))))
    before = F.last(F.when(F.col("_j") == chunk - 1, F.col("_local")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    y = F.col("_local") + F.coalesce(before, F.lit(0.0)) * power(F.col("_j") + 1)
    return b.withColumn(out, F.when(F.col("_i") + 1 >= min_samples, y)).drop("_i", "_c", "_j", "_local")


def span_average(bars: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """E3. Exponential average of a span, unadjusted, null until ``span`` values."""
    return exponential(bars, value, 2.0 / (span + 1.0), out, span)


def sma(bars: DataFrame, value: str, n: int, m: int, out: str) -> DataFrame:
    """The recursion with alpha = m / n, null until n values."""
    return exponential(bars, value, m / n, out, n)


# --------------------------------------------------------------- families over whole symbols (F)


def of_symbols() -> Windows:
    return Windows(("symbol",))


def complete_run(w: Windows, n: int, skip: int = 0) -> Column:
    """The n bars that end ``skip`` bars ago are there and complete: the last that isn't lies before them."""
    bad = F.when(~F.coalesce("is_complete", F.lit(False)), F.col("_at"))
    last_bad = w.ask(F.max(bad).over(w.window.rowsBetween(Window.unboundedPreceding, -skip)), None)
    return F.coalesce(last_bad, F.lit(-1)) < F.col("_at") - (skip + n - 1)


def momentum(bars: DataFrame, interval: str, lookback: str, skip: str | None = None, reverse: bool = False) -> DataFrame:
    """F1, F2. Return over ``lookback`` that ended ``skip`` ago."""
    w, n, k = of_symbols(), bars_in(lookback, interval), bars_in(skip, interval) if skip else 0
    now, past = w.lag(F.col("close"), k), w.lag(F.col("close"), k + n)
    t0, t1 = ms(w.lag(F.col("close_time"), k)), ms(w.lag(F.col("close_time"), k + n))
    good = is_finite(now) & is_finite(past) & (now > 0) & (past > 0) & complete_run(w, n + 1, k) & (t0 - t1 == n * seconds(interval) * 1000)
    value = ratio(now, past) - 1.0
    return raw(w.added(bars), F.when(good, -value if reverse else value))


def contiguous(w: Windows, n: int, interval: str) -> Column:
    return ms("open_time") - ms(w.lag(F.col("open_time"), n)) == n * seconds(interval) * 1000


def log_close() -> Column:
    return F.when(F.col("close") > 0, F.log("close"))


def volatility(bars: DataFrame, interval: str, window: str) -> DataFrame:
    """F3. Population deviation of log returns."""
    w, n = of_symbols(), bars_in(window, interval)
    value = w.std(log_close() - w.lag(log_close(), 1), n, 0)
    good = contiguous(w, n, interval) & complete_run(w, n + 1)
    return raw(w.added(bars), F.when(good, value))


def last_sum(w: Windows, column: str, n: int) -> Column:
    return w.over(rolling.total(F.col(column)), n, F.col(column))


def quote_volume(bars: DataFrame, interval: str, window: str) -> DataFrame:
    """F4. Rolling quote volume of complete, adjacent bars."""
    w, n = of_symbols(), bars_in(window, interval)
    value = last_sum(w, "quote_volume", n)
    good = contiguous(w, n - 1, interval) & complete_run(w, n)
    return raw(w.added(bars), F.when(good, value))


def taker_ratio(bars: DataFrame, interval: str, window: str) -> DataFrame:
    """F5. Share of taker buys in rolling quote volume."""
    w, n = of_symbols(), bars_in(window, interval)
    total, taker = last_sum(w, "quote_volume", n), last_sum(w, "taker_buy_quote_volume", n)
    good = contiguous(w, n - 1, interval) & complete_run(w, n) & (total > 0)
    return raw(w.added(bars), F.when(good, ratio(taker, total)))


def illiquidity(bars: DataFrame, interval: str, window: str) -> DataFrame:
    """F6. Mean of absolute log return per million of quote volume."""
    w, n = of_symbols(), bars_in(window, interval)
    r = F.abs(log_close() - w.lag(log_close(), 1))
    a = F.when((F.col("close") > 0) & (F.col("quote_volume") > 0), ratio(r, F.col("quote_volume")) * 1e6)
    value = w.mean(F.when(is_finite(a), a), n)
    good = contiguous(w, n, interval) & complete_run(w, n + 1)
    return raw(w.added(bars), F.when(good, value))


def sampled_mean(bars: DataFrame, interval: str, sample_interval: str, samples: int, reverse: bool = False) -> DataFrame:
    """F7, F8. Close over the mean of closes sampled back in time, each at its exact time."""
    w, k = by_symbol(), bars_in(sample_interval, interval)
    lags = [i * k for i in range(samples)]
    price = [F.lag("close", n).over(w) if n else F.col("close") for n in lags]
    good = F.lit(True)
    for n, p in zip(lags, price, strict=True):
        whole = F.coalesce(F.lag("is_complete", n).over(w) if n else F.col("is_complete"), F.lit(False))
        time = ms(F.lag("close_time", n).over(w)) if n else ms("close_time")
        good = good & whole & is_finite(p) & (p > 0) & (ms("close_time") - time == n * seconds(interval) * 1000)
    value = ratio(F.col("close"), sum(price[1:], price[0]) / samples) - 1.0
    return raw(bars, F.when(good, -value if reverse else value))


def raw(bars: DataFrame, value: Column) -> DataFrame:
    """(timestamp, symbol, raw_value): values at the bars' close."""
    return bars.select(F.col("close_time").alias("timestamp"), "symbol", value.alias("raw_value"))


def live_ema_ratio(bars: DataFrame, interval: str, candle: str, fast: int, slow: int) -> DataFrame:
    """F9. Ratio of two averages on a slower clock, previewed at every base bar.

    The averages advance on closed candles only and begin anew after a candle that is missing or
    incomplete. A base bar previews alpha * close + (1 - alpha) * average of the candles before.
    """
    step, base = seconds(candle) * 1000, seconds(interval) * 1000
    n = step // base
    t = ms("open_time")
    b = bars.withColumn("bucket", F.timestamp_millis(t - t % step))
    candles = b.groupBy("symbol", F.col("bucket").alias("open_time")).agg(
        F.max_by("close", "open_time").alias("close"),
        ((F.count("*") == n) & (F.count_distinct("open_time") == n) & F.bool_and("is_complete") & (F.max_by("close", "open_time") > 0)).alias("is_complete"),
    )
    runs = segments(candles, candle).where("is_complete")
    for span, name in ((fast, "fast"), (slow, "slow")):
        runs = exponential(runs, "close", 2.0 / (span + 1.0), name)
    w = Window.partitionBy("symbol", "segment").orderBy("open_time")
    prior = runs.withColumn("samples", F.row_number().over(w)).select(
        "symbol", F.timestamp_millis(ms("open_time") + step).alias("bucket"), F.col("fast").alias("prior_fast"), F.col("slow").alias("prior_slow"), "samples"
    )
    inside = Window.partitionBy("symbol", "bucket").orderBy("open_time")
    live = b.join(prior, ["symbol", "bucket"], "left").withColumns({
        "so_far": F.count("*").over(inside),
        "whole": F.sum(F.col("is_complete").cast("int")).over(inside),
        "expected": ((ms("close_time") - ms("bucket")) / base).cast("long"),
        "samples": F.coalesce("samples", F.lit(0)),
    })
    preview = lambda span, name: F.when(F.col("samples") > 0, 2.0 / (span + 1) * F.col("close") + (1 - 2.0 / (span + 1)) * F.col(name)).otherwise(F.col("close"))
    live = live.withColumns({"live_fast": preview(fast, "prior_fast"), "live_slow": preview(slow, "prior_slow")})
    good = F.col("is_complete") & (F.col("so_far") == F.col("expected")) & (F.col("whole") == F.col("expected")) & F.col("expected").between(1, n) & (F.col("samples") + 1 >= slow) & is_finite(F.col("close")) & (F.col("close") > 0) & (F.col("live_slow") > 0)
    return raw(live, F.when(good, ratio(F.col("live_fast"), F.col("live_slow")) - 1.0))


# --------------------------------------------------------------- families within segments (G, K)


def prepared(bars: DataFrame, interval: str) -> DataFrame:
    """Segments, and the values of the bar before within the segment."""
    w = by_symbol(*SEGMENT)
    b = segments(bars, interval)
    before = {f"{c}1": F.lag(c).over(w) for c in ("close", "high", "low", "volume", "quote_volume")}
    return b.withColumns(before).withColumn("change", F.col("close") - F.col("close1"))


def delay(w: Windows, c: str, n: int) -> Column:
    return w.lag(F.col(c), n)


def zero_unless(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(0.0)


def of_mean(n: int) -> Callable[[Windows], Column]:
    def build(w: Windows) -> Column:
        mean = w.mean(F.col("close"), n)
        return ratio(F.col("close") - mean, mean) * 100.0

    return build


def roc(n: int) -> Callable[[Windows], Column]:
    def build(w: Windows) -> Column:
        before = delay(w, "close", n)
        return ratio(F.col("close") - before, before) * 100.0

    return build


def up_down_volume(w: Windows, n: int, volume: str = "volume") -> Column:
    c, p = F.col("close"), F.col("close1")
    up = w.sum(zero_unless(c > p, F.col(volume)), n)
    down = w.sum(zero_unless(c <= p, F.col(volume)), n)
    return F.when(down > 0, ratio(up, down) * 100.0)


def strength(w: Windows, n: int, scale: float) -> Column:
    d = F.col("change")
    up = w.sum(zero_unless(d > 0, d), n)
    down = w.sum(zero_unless(d < 0, -d), n)
    return F.when(up + down > 0, ratio(up - down, up + down) * scale)


def regression(w: Windows, n: int) -> tuple[Column, Column]:
    """Slope of the close on its index over n bars, and the fit's share of variance."""
    place, c = F.col("_at").cast("double"), F.col("close")
    fitted = lambda told: w.over(rolling.whole(rolling.moments(place, c, told), c, n), n, c)
    return fitted(lambda m, xx, yy, xy: F.try_divide(xy, xx)), fitted(lambda m, xx, yy, xy: F.when(yy > 0, F.try_divide(xy * xy, xx * yy)))


def trend(w: Windows, n: int) -> Column:
    return ratio(regression(w, n)[0], F.col("close"))


def signed_fit(w: Windows, n: int) -> Column:
    slope, fit = regression(w, n)
    return F.when(fit.isNotNull(), fit * F.signum(slope))


def range_position(w: Windows, n: int) -> Column:
    c = F.col("close")
    low, high = (w.over(rolling.whole(kind(F.col(name)), c, n), n, c) for kind, name in ((rolling.lowest, "low"), (rolling.highest, "high")))
    return F.when(high > low, ratio(c - low, high - low))


def extreme_times(w: Windows, n: int) -> Column:
    """Place of the highest high less that of the lowest low (1 is the oldest), over n; the first of equals."""
    c, at = F.col("close"), F.col("_at")
    of = lambda name, place: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("v"), place.alias("p")))
    high = w.over(rolling.whole(rolling.highest(of("high", -at)), c, n), n, c)
    low = w.over(rolling.whole(rolling.lowest(of("low", at)), c, n), n, c)
    return (-high["p"] - low["p"]) / F.lit(float(n))


def persistence(w: Windows, n: int) -> Column:
    """Share of rises less share of falls; the segment's first bar has neither."""
    d = F.col("change")
    return w.mean((d > 0).cast("double"), n) - w.mean((d < 0).cast("double"), n)


def rises(w: Windows, n: int) -> Column:
    return w.sum((F.col("change") > 0).cast("double"), n) / float(n) * 100.0


def price_volume_corr(w: Windows, n: int) -> Column:
    x, v = ratio(F.col("close"), F.col("close1")), ratio(F.col("volume"), F.col("volume1"))
    return w.corr(x, F.when(x.isNotNull() & (v > -1), F.log(v + 1.0)), n)


def kst(rocs: tuple[int, ...] = (10, 15, 20, 30), smooths: tuple[int, ...] = (10, 10, 10, 15)) -> Callable[[Windows], Column]:
    def build(w: Windows) -> Column:
        changes = [ratio(F.col("close"), delay(w, "close", r)) - 1.0 for r in rocs]
        return sum(((i + 1) * w.mean(c, n) for i, (c, n) in enumerate(zip(changes, smooths, strict=True))), F.lit(0.0)) * 100.0

    return build


def vortex(w: Windows, n: int) -> Column:
    h, low = F.col("high"), F.col("low")
    spread = F.greatest(h - low, F.abs(h - F.col("close1")), F.abs(low - F.col("close1")))
    up, down = w.sum(F.abs(h - F.col("low1")), n), w.sum(F.abs(low - F.col("high1")), n)
    total = w.sum(spread, n)
    return F.when(total > 0, ratio(up - down, total))


def price_volume_trend(w: Windows, n: int) -> Column:
    r = ratio(F.col("close"), F.col("close1")) - 1.0
    total = w.sum(F.col("volume"), n)
    return F.when(total > 0, ratio(w.sum(F.col("volume") * r, n), total))


def trix(n: int) -> Callable[[DataFrame], DataFrame]:
    def build(b: DataFrame) -> DataFrame:
        for a, c in (("close", "_e1"), ("_e1", "_e2"), ("_e2", "_e3")):
            b = span_average(b, a, n, c)
        before = F.lag("_e3", 1).over(by_symbol(*SEGMENT))
        return raw(b, F.when(before > 0, (ratio(F.col("_e3"), before) - 1.0) * 100.0))

    return build


def tsi(slow: int = 25, fast: int = 13) -> Callable[[DataFrame], DataFrame]:
    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_abs", F.abs("change"))
        for a, c in (("change", "_n"), ("_abs", "_d")):
            b = span_average(span_average(b, a, slow, f"{c}1"), f"{c}1", fast, f"{c}2")
        return raw(b, F.when(F.col("_d2") > 0, ratio(F.col("_n2"), F.col("_d2")) * 100.0))

    return build


def smoothed_difference(lag: int, n: int) -> Callable[[DataFrame], DataFrame]:
    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_x", F.col("close") - F.lag("close", lag).over(by_symbol(*SEGMENT)))
        return raw(sma(b, "_x", n, 1, "_y"), F.col("_y"))

    return build


def macd_like(b: DataFrame) -> DataFrame:
    b = sma(sma(b, "close", 13, 2, "_fast"), "close", 27, 2, "_slow").withColumn("_d", F.col("_fast") - F.col("_slow"))
    return raw(sma(b, "_d", 10, 2, "_s"), 2.0 * (F.col("_d") - F.col("_s")))


def affine(b: DataFrame, a: str, add: str, out: str, keys: tuple[str, ...] = ("symbol", "segment"), order: str = "open_time", forgotten: float = 60.0) -> DataFrame:
    """y = a y_before + add over ``keys`` in order, for 0 < a <= 1, from y_before = 0; rows with a null ``a`` leave y as it is.

    The maps of a stretch compose to one: y = P (y_before + sum of add / P), P the product of a so far.
    A stretch ends where the logarithm of its product has fallen by ``forgotten``: then what came
    before the last whole stretch weighs less than rounding, so a row needs its own stretch and the end
    of the one before. A first row of which y shall begin takes a = 1 and ``add`` = y.
    """
    x = F.coalesce(F.log(a), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(order)
    b = b.withColumn("_s", F.floor(-F.sum(x).over(w) / forgotten))
    inside = Window.partitionBy(*keys, "_s").orderBy(order)
    b = b.withColumn("_p", F.exp(F.sum(x).over(inside)))
    b = b.withColumn("_own", F.col("_p") * F.sum(F.coalesce(F.col(add), F.lit(0.0)) / F.col("_p")).over(inside))
    b = b.withColumn("_end", F.when(F.lead("_s").over(w) > F.col("_s"), F.col("_own")))
    before = F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn(out, F.col("_own") + F.coalesce(before, F.lit(0.0)) * F.col("_p")).drop("_s", "_p", "_own", "_end")


def kama(n: int = 10, fast: int = 2, slow: int = 30) -> Callable[[DataFrame], DataFrame]:
    """K12. Distance from Kaufman's adaptive average: level += pace (close - level), an affine step
    whose pace depends on the data. A window without movement skips the update and has no value."""
    if fast < 2:
        raise ValueError("a fast span under 2 forgets the level at once")

    def build(b: DataFrame) -> DataFrame:
        w, c = Windows(), F.col("close")
        before = w.lag(c, n)
        noise = w.sum(F.abs(c - w.lag(c, 1)), n)
        b = w.added(b.where("is_complete").drop("_at")).withColumns({"_noise": noise, "_move": F.abs(c - before)})
        first, last = 2.0 / (fast + 1.0), 2.0 / (slow + 1.0)
        pace = F.pow(F.col("_move") / F.col("_noise") * (first - last) + last, F.lit(2.0))
        b = b.withColumn("_pace", F.when((F.col("_at") >= n) & (F.col("_noise") > 0), pace))
        b = b.withColumns({"_a": 1.0 - F.col("_pace"), "_b": F.when(F.col("_at") == n - 1, c).otherwise(F.col("_pace") * c)})
        b = affine(b, "_a", "_b", "_level")
        value = F.when(F.col("_pace").isNotNull(), ratio(c, F.col("_level")) - 1.0)
        return raw(b, F.when(is_finite(value), value))

    return build


Builder = Callable[[Windows], Column] | Callable[[DataFrame], DataFrame]


class Entry(NamedTuple):
    build: Builder
    whole: bool = False  # builds a table instead of a column


#: Registry of the factors within segments: name -> builder.
REGISTRY: dict[str, Entry] = {
    "alpha18": Entry(lambda w: ratio(F.col("close"), delay(w, "close", 5))),
    "alpha20": Entry(roc(6)),
    "alpha24": Entry(smoothed_difference(5, 5), True),
    "alpha31": Entry(of_mean(12)),
    "alpha40": Entry(lambda w: up_down_volume(w, 26)),
    "alpha53": Entry(lambda w: rises(w, 12)),
    "alpha66": Entry(of_mean(6)),
    "alpha71": Entry(of_mean(24)),
    "alpha88": Entry(roc(20)),
    "alpha89": Entry(macd_like, True),
    "alpha112": Entry(lambda w: strength(w, 12, 100.0)),
    "alpha151": Entry(smoothed_difference(20, 20), True),
    "trend": Entry(lambda w: trend(w, 10)),
    "signed_fit": Entry(lambda w: signed_fit(w, 10)),
    "range_position": Entry(lambda w: range_position(w, 10)),
    "extreme_times": Entry(lambda w: extreme_times(w, 10)),
    "persistence": Entry(lambda w: persistence(w, 10)),
    "strength": Entry(lambda w: strength(w, 10, 1.0)),
    "roc_momentum": Entry(lambda w: ratio(F.col("close"), delay(w, "close", 10)) - 1.0),
    "price_volume_corr": Entry(lambda w: price_volume_corr(w, 10)),
    "trix": Entry(trix(5), True),
    "tsi": Entry(tsi(8, 4), True),
    "kst": Entry(kst((4, 6, 8, 10), (4, 4, 4, 6))),
    "kama": Entry(kama(), True),
    "vortex": Entry(lambda w: vortex(w, 10)),
    "price_volume_trend": Entry(lambda w: price_volume_trend(w, 10)),
}


def segment_factor(bars: DataFrame, interval: str, name: str) -> DataFrame:
    """A registered factor over ``bars``: (timestamp, symbol, raw_value)."""
    entry, b = REGISTRY[name], prepared(bars, interval)
    if entry.whole:
        return entry.build(b)
    w = Windows()
    value = entry.build(w)
    return raw(w.added(b), F.when(F.col("is_complete"), value))


# ------------------------------------------------------------------------- user expressions (E)


class Bars(Windows):
    """Builders for user expressions over ``symbol`` and ``segment``: lags, and means, sums, minima, maxima, deviations and correlations of the last n bars."""

    FIELDS = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume")


def expression_factor(bars: DataFrame, interval: str, build: Callable[[Bars], Column], direction: int = 1) -> DataFrame:
    """E1, E2, E5. A user's column over gap segments, with the sign of ``direction``."""
    w = Bars()
    value = build(w)
    return raw(w.added(segments(bars, interval)), F.when(F.col("is_complete"), value * direction))


# --------------------------------------------------------------------------------- the driver A0


def factor_panel(raw_values: DataFrame, universe: DataFrame, interval: str, name: str, version: str, dataset_version: str) -> DataFrame:
    """A0. Raw values on the thinned clock of the eligible panel, with validity and versions."""
    eligible = universe.where("is_eligible").select("timestamp", "symbol", "universe_version")
    joined = thin(eligible, interval).join(thin(raw_values, interval), ["timestamp", "symbol"], "left")
    reason = F.when(F.col("raw_value").isNull(), "INSUFFICIENT_OR_GAPPED_HISTORY").when(~is_finite(F.col("raw_value")), "NON_FINITE")
    return joined.select(
        "timestamp", "symbol", F.lit(name).alias("factor_name"), F.lit(version).alias("factor_version"), "raw_value",
        F.when(reason.isNull(), F.col("raw_value")).alias("value"), reason.isNull().alias("is_valid"), reason.alias("invalid_reason"),
        "universe_version", F.lit(dataset_version).alias("dataset_version"),
    )
