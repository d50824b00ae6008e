"""Streaming jobs over several micro-batches against the batch results."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from crosspan.operators import factors
from crosspan.streaming import jobs

H = 3_600_000
T0 = 1704067200000


def bars(spark, n=64, missing=(20, 41)):
    rnd = random.Random(2)
    rows = [(s, T0 + i * H, 50 + rnd.random() * 10, rnd.random() < 0.97) for s in "ab" for i in range(n) if i not in missing]
    df = spark.createDataFrame(rows, "symbol string, t long, close double, is_complete boolean")
    return df.withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + H)})


def stream_of(spark, df, folder, cuts):
    """The table in files by time, the first of which is there at the start; each run adds one."""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where((F.col("t") >= T0 + a * H) & (F.col("t") < T0 + b * H)).coalesce(1).write.mode("append").parquet(folder)
        yield k, jobs.source(spark, folder)


def test_live_average_carries_its_state_over_batches(spark, tmp_path):
    b = bars(spark)
    for _, stream in stream_of(spark, b, str(tmp_path / "in"), [0, 13, 30, 31, 64]):
        out = jobs.run_available(jobs.live_ema(stream, "1h", "4h", 2, 3), str(tmp_path / "out"))
    got = {(r.symbol, r.t): round(r.raw_value, 9) for r in out.where("raw_value is not null").collect()}
    batch = factors.live_ema_ratio(b, "1h", "4h", 2, 3).where("raw_value is not null")
    assert got == {(r.symbol, r.t): round(r.raw_value, 9) for r in batch.select("symbol", F.unix_millis("timestamp").alias("t"), "raw_value").collect()} and got


def test_history_and_alerts_over_batches(spark, tmp_path):
    b = bars(spark)
    for _, stream in stream_of(spark, b, str(tmp_path / "in"), [0, 10, 64]):
        out = jobs.run_available(jobs.history(stream), str(tmp_path / "h"))
    last = {r.symbol: (r.n, r.f) for r in out.groupBy("symbol").agg(F.max("history_bars").alias("n"), F.min(F.unix_millis("first_bar_open")).alias("f")).collect()}
    assert last == {r.symbol: (r.n, r.f) for r in b.groupBy("symbol").agg(F.sum(F.col("is_complete").cast("long")).alias("n"), F.min("t").alias("f")).collect()}
    scores = b.select("symbol", "t", F.col("open_time").alias("timestamp"), F.col("close").alias("value"), F.lit(True).alias("is_valid"))
    for _, stream in stream_of(spark, scores, str(tmp_path / "s"), [0, 25, 64]):
        alerts = jobs.run_available(jobs.crossover_alerts(stream, 55.0, 55.0, "1h"), str(tmp_path / "a"))
    rows = {(r.symbol, r.t): r.value for r in scores.collect()}
    want = set()
    for (s, t), v in rows.items():
        p = rows.get((s, t - H))
        if p is not None and ((p <= 55 < v) or (p >= 55 > v)):
            want.add((s, t, "LONG" if v > 55 else "FLAT"))
    assert {(r.symbol, r.t, r.side) for r in alerts.collect()} == want


def test_descent_alerts_fire_once(spark, tmp_path):
    ranks = [9, 7, 5, 2, 2, 1, 8, 2, 9, 3]
    df = spark.createDataFrame([("a", T0 + i * H, r) for i, r in enumerate(ranks)], "symbol string, t long, ordinal_rank int").withColumn("timestamp", F.timestamp_millis("t"))
    for _, stream in stream_of(spark, df, str(tmp_path / "in"), [0, 2, 6, 10]):
        out = jobs.run_available(jobs.descent_alerts(stream, 6, 2, "1h"), str(tmp_path / "out"))
    assert sorted((r.t - T0) // H for r in out.collect()) == [3, 7]


def test_late_bars_are_dropped_and_windows_close_once(spark, tmp_path):
    e = lambda rows: spark.createDataFrame(rows, "symbol string, t long, event_id long, value double").withColumn("ts", F.timestamp_millis("t"))
    folder = str(tmp_path / "in")
    e([("a", T0, 1, 1.0), ("a", T0 + 1000, 2, 3.0), ("a", T0 + 4 * H, 3, 2.0)]).coalesce(1).write.parquet(folder)
    jobs.run_available(jobs.resample(jobs.source(spark, folder), "1h", "1 hour"), str(tmp_path / "out"))
    e([("a", T0 + 2000, 4, 99.0), ("a", T0 + 9 * H, 5, 5.0)]).coalesce(1).write.mode("append").parquet(folder)
    out = jobs.run_available(jobs.resample(jobs.source(spark, folder), "1h", "1 hour"), str(tmp_path / "out"))
    got = {(r.o, r.open, r.high, r.close, r.trades) for r in out.select(F.unix_millis("open_time").alias("o"), "open", "high", "close", "trades").collect()}
    assert got == {(T0, 1.0, 3.0, 3.0, 2), (T0 + 4 * H, 2.0, 2.0, 2.0, 1)}


def test_rewound_bars_are_left_out_and_idle_states_go(spark, tmp_path):
    rows = [("a", T0 + 5 * H, 1.0), ("a", T0 + 6 * H, 2.0)], [("a", T0 + 4 * H, 3.0), ("a", T0 + 6 * H, 4.0), ("a", T0 + 7 * H, 5.0), ("b", T0 + 6 * H, 6.0)], [("b", T0 + 500 * H, 7.0)], [("b", T0 + 501 * H, 8.0)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in rows:
        df = spark.createDataFrame(part, "symbol string, t long, close double").withColumn("open_time", F.timestamp_millis("t"))
        df.coalesce(1).write.mode("append").parquet(folder)
        got = jobs.run_available(jobs.forward_only(jobs.source(spark, folder), "2 hours", "24h"), out)
    assert sorted((r.symbol, (r.t - T0) // H) for r in got.collect()) == [("a", 5), ("a", 6), ("a", 7), ("b", 6), ("b", 500), ("b", 501)]


def test_null_values_are_no_trades(spark, tmp_path, monkeypatch):
    from crosspan.plans import stream_queries

    rows = [(1, T0, "click", 1.0), (2, T0 + 1000, "click", None), (3, T0 + 2000, "click", 3.0), (4, T0 + 90 * H, "click", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t long, event_type string, value double").selectExpr("event_id", "timestamp_millis(t) as ts", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = stream_queries.z1_stream_resample(spark, str(tmp_path)).collect()
    assert [(r.open, r.close, r.trades) for r in got] == [(1.0, 3.0, 2)]


def test_streams_go_on_from_what_a_batch_has_seen(spark, tmp_path):
    """The state of a batch and a stream over the rest give what a stream over all gives, and so does a restart."""
    b = bars(spark)
    scores = b.select("symbol", "t", F.col("open_time").alias("timestamp"), F.col("close").alias("value"), F.lit(True).alias("is_valid"))
    ranks = b.select("symbol", "t", F.col("open_time").alias("timestamp"), F.floor(F.col("close") - 50).cast("int").alias("ordinal_rank"))
    cases = {
        "forward": (b, lambda s, i: jobs.forward_only(s, initial=i), jobs.forward_state),
        "ema": (b, lambda s, i: jobs.live_ema(s, "1h", "4h", 2, 3, initial=i), lambda df: jobs.live_ema_state(df, "4h", "1h", 2, 3)),
        "cross": (scores, lambda s, i: jobs.crossover_alerts(s, 55.0, 55.0, "1h", initial=i), jobs.crossover_state),
        "descent": (ranks, lambda s, i: jobs.descent_alerts(s, 6, 2, "1h", initial=i), lambda df: jobs.descent_state(df, 6, 2, "1h")),
    }
    for name, (rows, job, state) in cases.items():
        folder = tmp_path / name
        for _, stream in stream_of(spark, rows, str(folder / "all"), [0, 64]):
            whole = jobs.run_available(job(stream, None), str(folder / "whole")).collect()
        cut = T0 + 27 * H
        for _, stream in stream_of(spark, rows.where(F.col("t") >= cut), str(folder / "rest"), [27, 45, 64]):  # the second run restarts from the checkpoint
            rest = jobs.run_available(job(stream, state(rows.where(F.col("t") < cut))), str(folder / "out")).collect()
        late = H if name == "ema" else 0  # its t is the close
        rounded = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)
        want = rounded(r for r in whole if r.t >= cut + late)
        assert rounded(rest) == want and want, name


def test_history_goes_on_from_a_batch(spark, tmp_path):
    b = bars(spark)
    for _, stream in stream_of(spark, b.where(F.col("t") >= T0 + 30 * H), str(tmp_path / "in"), [30, 50, 64]):
        out = jobs.run_available(jobs.history(stream, initial=jobs.history_state(b.where(F.col("t") < T0 + 30 * H))), str(tmp_path / "out"))
    got = {r.symbol: (r.n, r.f) for r in out.groupBy("symbol").agg(F.max("history_bars").alias("n"), F.min(F.unix_millis("first_bar_open")).alias("f")).collect()}
    assert got == {r.symbol: (r.n, r.f) for r in b.groupBy("symbol").agg(F.count_if("is_complete").alias("n"), F.min("t").alias("f")).collect()}


def test_settlements_meet_the_bars_of_their_slot_alone(spark, tmp_path):
    """Bars that begin between multiples of the interval too; the join's key holds the slot of time."""
    from crosspan.functions.core import ms

    rnd = random.Random(6)
    shift = {"a": 0, "b": H // 3}
    bars_ = spark.createDataFrame([(s, T0 + shift[s] + i * H, float(i)) for s in "ab" for i in range(40) if i % 7], "symbol string, t long, close double").withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + H)})
    at = [T0 + i * H + d for i in range(-1, 42) for d in (0, 1, H // 3, H // 3 + 1, rnd.randrange(H))]
    paid = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate((s, t) for s in "abc" for t in at)], "symbol string, t long, event_id long").withColumn("funding_time", F.timestamp_millis("t"))
    opens = {s: [T0 + shift[s] + i * H for i in range(40) if i % 7] for s in "ab"}
    want = sorted((r.event_id, o) for r in paid.collect() for o in opens.get(r.symbol, ()) if o < r.t <= o + H)
    bars_.drop("t").write.parquet(str(tmp_path / "bars"))
    paid.drop("t").write.parquet(str(tmp_path / "paid"))
    joined = jobs.funding_join(jobs.source(spark, str(tmp_path / "paid")), jobs.source(spark, str(tmp_path / "bars")), "1h", "1 day")
    # An equality, which the join hashes by: without the slot all rows of a symbol meet.
    assert re.search(r"\(_fslot#\d+L = _slot#\d+L\)", joined._jdf.queryExecution().analyzed().toString())
    out = jobs.run_available(joined, str(tmp_path / "out"))
    assert out.columns == ["_symbol", "event_id", "funding_time", "symbol", "open_time", "close_time", "close"]
    assert sorted((r.event_id, r.t) for r in out.select("event_id", ms("open_time").alias("t")).collect()) == want and want
