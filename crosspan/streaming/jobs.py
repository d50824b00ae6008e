"""Structured Streaming forms of the panel operators.

Every job is a plain transformation of a streaming DataFrame; :func:`run_available` drives one over
what its source holds, to a Parquet sink with a checkpoint, as a scheduled job would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from crosspan.functions.core import ms, seconds
from crosspan.operators.factors import exponential
from crosspan.operators.timeaxis import segments

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with the schema that the files have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there, append to ``path``/out, and return what it holds.

    State lies in RocksDB, on the executors' disks and as changes in the checkpoint: the jobs with a state
    for each symbol need it, and no executor's memory holds all symbols.
    """
    spark = stream.sparkSession
    named = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, named) if named else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def resample(events: DataFrame, interval: str, delay: str, complete_trades: int = 1) -> DataFrame:
    """Z1. Tumbling OHLC of (symbol, ts, event_id, value); bars later than ``delay`` are dropped."""
    at = F.struct("ts", "event_id")
    w = F.window("ts", f"{seconds(interval)} seconds")
    out = events.withWatermark("ts", delay).groupBy(w, "symbol").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("trades")
    )
    return out.select("symbol", F.col("window.start").alias("open_time"), F.col("window.end").alias("close_time"), "open", "high", "low", "close", "trades", (F.col("trades") >= complete_trades).alias("is_complete"))


def without_duplicates(bars: DataFrame, delay: str) -> DataFrame:
    """Z2. The first row of each (symbol, open_time); the watermark bounds how far back it looks."""
    return bars.withWatermark("open_time", delay).dropDuplicatesWithinWatermark(["symbol", "open_time"])


KEEP = "400d"


class Fold(StatefulProcessor):
    """A typed state for each symbol, with a timer on event time at which it goes.

    ``step`` takes the symbol, its rows in order of ``t`` and the state's values or None, and gives the
    new ones and the rows to put out. The last value held is the last ``t``.
    """

    def __init__(self, step: Callable, state: str, names: list[str], keep: int, least: bool) -> None:
        self.step, self.fields, self.names, self.keep, self.least = step, state, names, keep, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.fields)
        self.due = handle.getValueState("due", "at long")

    def hold(self, values: tuple, timers: TimerValues) -> None:
        self.held.update(values)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = max(values[-1] + self.keep, timers.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: TimerValues) -> None:
        self.hold(tuple(v.item() if hasattr(v, "item") else v for v in (initial[part.split()[0]].iloc[0] for part in self.fields.split(", "))), timers)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        batch = pd.concat(list(rows)).sort_values("t", kind="stable")
        if self.least:
            batch = batch.drop_duplicates("t")
            batch = batch[batch["t"] > before[-1]] if before else batch
        if len(batch):
            after, out = self.step(key[0], batch, before)
            self.hold((*after, max(int(batch["t"].max()), before[-1] if before else 0)), timers)
            yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, time: str, delay: str, keep: str, step: Callable, output: str, state: str, least: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """A state for each symbol, which goes ``keep`` after the symbol's last row by event time.

    ``t`` is ``time`` in ms; with ``least`` rows at or before the last one are left out, as duplicates or
    rewound. ``initial`` has a row (symbol, the state's fields) for each symbol that a batch has seen
    before; it counts at a checkpoint's first start alone. The state lies in RocksDB (see
    :func:`run_available`).
    """
    names = [part.split()[0] for part in output.split(", ")]
    timed = stream.withColumn("t", ms(time)).withWatermark(time, delay)
    held = initial.select("symbol", *(F.col(n).cast(kind).alias(n) for n, kind in (part.split() for part in state.split(", ")))).groupBy("symbol") if initial is not None else None
    return timed.groupBy("symbol").transformWithStateInPandas(Fold(step, state, names, seconds(keep) * 1000, least), output, "append", "EventTime", initialState=held)


def forward_only(bars: DataFrame, delay: str = "1 day", keep: str = KEEP, initial: DataFrame | None = None) -> DataFrame:
    """Z2. Bars that open after all that their symbol has had: duplicates and rewound bars are left out."""

    def step(symbol: str, rows: pd.DataFrame, before: tuple | None) -> tuple[tuple, dict]:
        return (), {"symbol": symbol, "t": rows["t"], "close": rows["close"].astype(float)}

    return stateful(bars.select("symbol", "open_time", "close"), "open_time", delay, keep, step, "symbol string, t long, close double", "last long", initial=initial)


def forward_state(bars: DataFrame) -> DataFrame:
    """What :func:`forward_only` holds after these bars."""
    return bars.groupBy("symbol").agg(F.max(ms("open_time")).alias("last"))


def history(bars: DataFrame, delay: str = "1 day", keep: str = KEEP, initial: DataFrame | None = None) -> DataFrame:
    """Z3. After each batch: bars so far and the first open, of the symbols that it had."""

    def step(symbol: str, rows: pd.DataFrame, before: tuple | None) -> tuple[tuple, list[tuple]]:
        n, first, _ = before or (0, int(rows["t"].min()), 0)
        n, first = n + int(rows["is_complete"].sum()), min(first, int(rows["t"].min()))
        return (n, first), [(symbol, n, pd.Timestamp(first, unit="ms"))]

    return stateful(bars.select("symbol", "open_time", "is_complete"), "open_time", delay, keep, step, "symbol string, history_bars long, first_bar_open timestamp", "n long, first long, last long", least=False, initial=initial)


def history_state(bars: DataFrame) -> DataFrame:
    """What :func:`history` holds after these bars."""
    return bars.groupBy("symbol").agg(F.count_if("is_complete").alias("n"), F.min(ms("open_time")).alias("first"), F.max(ms("open_time")).alias("last"))


def live_ema(bars: DataFrame, interval: str, candle: str, fast: int, slow: int, delay: str = "1 day", keep: str = KEEP, initial: DataFrame | None = None) -> DataFrame:
    """Z4. Live ratio of two averages; the state holds the closed candles' averages and the open candle.

    Within a batch only the averages go candle by candle; all bars are counted and previewed together.
    """
    step_ms, base = seconds(candle) * 1000, seconds(interval) * 1000
    n = step_ms // base
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def step(symbol: str, rows: pd.DataFrame, before: tuple | None) -> tuple[tuple, dict]:
        f, s, samples, bucket, seen, whole, last, _ = before or (0.0, 0.0, 0, -1, 0, 0, 0.0, 0)
        t, close, complete = rows["t"].to_numpy(np.int64), rows["close"].to_numpy(float), rows["is_complete"].to_numpy(bool)
        mine = t - t % step_ms
        starts = np.flatnonzero(np.diff(mine, prepend=mine[0] - 1))
        candle_of = np.searchsorted(starts, np.arange(len(t)), side="right") - 1
        n_seen, n_whole = np.arange(1, len(t) + 1) - starts[candle_of], np.cumsum(complete)
        n_whole = n_whole - (n_whole[starts] - complete[starts])[candle_of]
        if mine[0] == bucket:
            n_seen, n_whole = n_seen + seen * (candle_of == 0), n_whole + whole * (candle_of == 0)
        ends = np.append(starts[1:], len(t)) - 1
        prior = np.empty((len(starts), 3))
        for k, i in enumerate(starts):
            if mine[i] != bucket:
                good = bucket >= 0 and seen == n and whole == n and last > 0
                if good:
                    f, s = (a * last + (1 - a) * f, b * last + (1 - b) * s) if samples else (last, last)
                samples = samples + 1 if good and mine[i] == bucket + step_ms else 0
            prior[k] = f, s, samples
            bucket, seen, whole, last = int(mine[i]), int(n_seen[ends[k]]), int(n_whole[ends[k]]), float(close[ends[k]])
        pf, ps, k = prior[candle_of].T
        x, y = np.where(k > 0, a * close + (1 - a) * pf, close), np.where(k > 0, b * close + (1 - b) * ps, close)
        expected = (t + base - mine) // base
        shown = complete & (n_seen == expected) & (n_whole == expected) & (k + 1 >= slow) & (close > 0) & (y > 0)
        return (f, s, samples, bucket, seen, whole, last), {"symbol": symbol, "t": t[shown] + base, "raw_value": x[shown] / y[shown] - 1.0}

    return stateful(bars.select("symbol", "open_time", "close", "is_complete"), "open_time", delay, keep, step, "symbol string, t long, raw_value double", "f double, s double, samples long, bucket long, seen long, whole long, close double, last long", initial=initial)


def live_ema_state(bars: DataFrame, candle: str, interval: str, fast: int, slow: int) -> DataFrame:
    """What :func:`live_ema` holds after these bars: windows over candles, no fold."""
    step_ms = seconds(candle) * 1000
    n = step_ms // (seconds(interval) * 1000)
    t = ms("open_time")
    candles = bars.groupBy("symbol", F.timestamp_millis(t - t % step_ms).alias("_open")).agg(
        F.max_by("close", "open_time").alias("close"), F.count("*").alias("seen"), F.count_if("is_complete").alias("whole"), F.max(t).alias("last")
    ).withColumnRenamed("_open", "open_time").withColumn("is_complete", (F.col("seen") == n) & (F.col("whole") == n) & (F.col("close") > 0))
    newest = F.max("open_time").over(Window.partitionBy("symbol"))
    rows = segments(candles, candle).withColumn("_newest", F.col("open_time") == newest)
    runs = rows.where("is_complete and not _newest")
    for span, name in ((fast, "f"), (slow, "s")):
        runs = exponential(runs, "close", 2.0 / (span + 1), name)
    runs = runs.withColumn("samples", F.row_number().over(Window.partitionBy("symbol", "segment").orderBy("open_time")))
    closed = runs.select("symbol", "f", "s", "samples", F.timestamp_millis(ms("open_time") + step_ms).alias("open_time"))
    held = rows.where("_newest").join(closed, ["symbol", "open_time"], "left")
    return held.select("symbol", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("f", "s", "samples")), ms("open_time").alias("bucket"), "seen", "whole", "close", "last")


def crossover_alerts(scores: DataFrame, entry: float, exit_: float, every: str, delay: str = "1 day", keep: str = KEEP, initial: DataFrame | None = None) -> DataFrame:
    """Z5. LONG and FLAT alerts between scores that are ``every`` apart; the state is the last score."""
    gap = seconds(every) * 1000

    def step(symbol: str, rows: pd.DataFrame, before: tuple | None) -> tuple[tuple, dict]:
        value, t = rows["value"].to_numpy(float), rows["t"].to_numpy(np.int64)
        prior, t0 = before or (np.nan, -gap)
        p = np.append(prior, value[:-1])
        near = (t - np.append(t0, t[:-1]) == gap) & ~np.isnan(p)
        long, flat = near & (p <= entry) & (value > entry), near & (p >= exit_) & (value < exit_)
        out = long | flat
        return (float(value[-1]),), {"symbol": symbol, "t": t[out], "score": value[out], "side": np.where(long[out], "LONG", "FLAT")}

    return stateful(scores.where("is_valid").select("symbol", "timestamp", "value"), "timestamp", delay, keep, step, "symbol string, t long, score double, side string", "prior double, last long", initial=initial)


def crossover_state(scores: DataFrame) -> DataFrame:
    """What :func:`crossover_alerts` holds after these scores."""
    return scores.where("is_valid").groupBy("symbol").agg(F.max_by("value", "timestamp").alias("prior"), F.max(ms("timestamp")).alias("last"))


def rank_snapshots(scores: DataFrame, delay: str) -> DataFrame:
    """Z6. Ranks of each timestamp, once the watermark has closed it: a snapshot is whole or absent."""
    closed = scores.where("is_valid").withWatermark("timestamp", delay).groupBy("timestamp").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("_o"), "symbol"))).alias("rows"))
    return closed.select("timestamp", F.size("rows").alias("sample_count"), F.posexplode("rows").alias("_i", "r")).select("timestamp", "r.symbol", (F.col("_i") + 1).alias("ordinal_rank"), "sample_count")


def descent_alerts(ranks: DataFrame, start: int, entry: int, every: str, delay: str = "1 day", keep: str = KEEP, initial: DataFrame | None = None) -> DataFrame:
    """Z6. Fires once in an unbroken run of falling ranks from ``start`` when it reaches ``entry``."""
    gap = seconds(every) * 1000

    def step(symbol: str, rows: pd.DataFrame, before: tuple | None) -> tuple[tuple, dict]:
        rank, t = rows["ordinal_rank"].to_numpy(np.int64), rows["t"].to_numpy(np.int64)
        previous, alive, t0 = before or (0, False, -1)
        begins = (t - np.append(t0, t[:-1]) != gap) | (rank > np.append(previous, rank[:-1]))
        if before is None:
            begins[0] = True
        run = np.cumsum(begins)  # 0: the run that the state is in
        live = np.append(alive, rank[begins] >= start)
        hits = np.flatnonzero(live[run] & ~begins & (rank == entry))
        fired, at = np.unique(run[hits], return_index=True)
        live[fired] = False
        out = hits[at]
        return (int(rank[-1]), bool(live[run[-1]])), {"symbol": symbol, "t": t[out], "ordinal_rank": rank[out]}

    return stateful(ranks.select("symbol", "timestamp", "ordinal_rank"), "timestamp", delay, keep, step, "symbol string, t long, ordinal_rank long", "previous long, alive boolean, last long", initial=initial)


def descent_state(ranks: DataFrame, start: int, entry: int, every: str) -> DataFrame:
    """What :func:`descent_alerts` holds after these ranks."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    begins = (ms("timestamp") - ms(F.lag("timestamp").over(w)) == seconds(every) * 1000) & (F.col("ordinal_rank") <= F.lag("ordinal_rank").over(w))
    rows = ranks.withColumn("_new", (~F.coalesce(begins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy("symbol", "_run").agg(F.min_by("ordinal_rank", "timestamp").alias("_from"), F.max_by("ordinal_rank", "timestamp").alias("previous"), F.count_if((F.col("_new") == 0) & (F.col("ordinal_rank") == entry)).alias("_hits"), F.max(ms("timestamp")).alias("last"))
    return runs.groupBy("symbol").agg(F.max_by("previous", "_run").alias("previous"), F.max_by((F.col("_from") >= start) & (F.col("_hits") == 0), "_run").alias("alive"), F.max("last").alias("last"))


def funding_join(funding: DataFrame, bars: DataFrame, interval: str, delay: str) -> DataFrame:
    """Z7. Settlements with the bar in whose (open_time, close_time] they fall, as two streams.

    Both go to the state by symbol and slot of time, so that a row meets the few of its slot and not all of its
    symbol. A settlement has one slot; a bar has that of its first and that of its last moment, which are the same
    if bars begin at multiples of the interval.
    """
    step = seconds(interval) * 1_000_000
    slot = lambda micros: F.floor(micros / step)
    opened = F.unix_micros("open_time")
    f = funding.withWatermark("funding_time", delay).withColumnRenamed("symbol", "_symbol").withColumn("_fslot", slot(F.unix_micros("funding_time") - 1))
    b = bars.select("symbol", "open_time", "close_time", "close").withWatermark("open_time", delay)
    b = b.withColumn("_slot", F.explode(F.array_distinct(F.array(slot(opened), slot(opened + step - 1)))))
    on = (F.col("_fslot") == F.col("_slot")) & (F.col("_symbol") == F.col("symbol")) & (F.col("funding_time") > F.col("open_time")) & (F.col("funding_time") <= F.col("open_time") + F.expr(f"interval {seconds(interval)} seconds"))
    return f.join(b, on).drop("_fslot", "_slot")


