"""Factors: closed forms, causality, gap resets, and independence of row order and partitions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from crosspan.operators import factors, timeaxis

H = 3_600_000
T0 = 1704067200000


def bars(spark, n=60, symbols=("a", "b"), missing=(), incomplete=(), seed=1, tail=None):
    """Hourly bars; ``tail`` = (from index, factor) changes the later closes."""
    rnd, rows = random.Random(seed), []
    for s in symbols:
        for i in range(n):
            o, c = 50 + rnd.random() * 10, 50 + rnd.random() * 10
            q = 100 + rnd.random() * 50
            if i in missing:
                continue
            if tail and i >= tail[0]:
                c *= tail[1]
            rows.append((s, T0 + i * H, o, max(o, c) + 1, min(o, c) - 1, c, q / 2, q, 10, q / 4, q / 3, i not in incomplete))
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_volume double, taker_buy_quote_volume double, is_complete boolean")
    return df.withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + H), "interval": F.lit("1h")}).drop("t")


def values(df):
    return {(r.symbol, r.t): r.raw_value for r in df.select("symbol", F.unix_millis("timestamp").alias("t"), "raw_value").collect()}


MAKERS = {
    "momentum": lambda b: factors.momentum(b, "1h", "5h"), "volatility": lambda b: factors.volatility(b, "1h", "5h"), "illiquidity": lambda b: factors.illiquidity(b, "1h", "5h"),
    "sampled": lambda b: factors.sampled_mean(b, "1h", "2h", 3), "live": lambda b: factors.live_ema_ratio(b, "1h", "4h", 2, 3),
} | {name: (lambda b, name=name: factors.segment_factor(b, "1h", name)) for name in ("alpha24", "alpha40", "alpha112", "trend", "extreme_times", "price_volume_corr", "trix", "kama", "vortex")}


@pytest.mark.parametrize("name", MAKERS)
def test_the_future_does_not_change_the_past(spark, name):
    make = MAKERS[name]
    a, b = values(make(bars(spark))), values(make(bars(spark, tail=(45, 3.0))))
    before = [k for k in a if k[1] <= T0 + 45 * H]
    assert before and any(a[k] is not None for k in before)
    for k in before:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-12))


@pytest.mark.parametrize("name", MAKERS)
def test_a_gap_makes_what_spans_it_null(spark, name):
    got = values(MAKERS[name](bars(spark, missing=(30,))))
    assert got.get(("a", T0 + 32 * H)) is None


@pytest.mark.parametrize("name", ["momentum", "alpha89", "tsi", "kama"])
def test_partitions_do_not_change_results(spark, name):
    make = MAKERS.get(name) or (lambda b: factors.segment_factor(b, "1h", name))
    a, b = values(make(bars(spark))), values(make(bars(spark).repartition(7)))
    assert a.keys() == b.keys()
    assert all((a[k] is None and b[k] is None) or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)


@pytest.mark.parametrize("alpha", [0.5, 0.05, 1.0])
def test_recursion_matches_a_loop_over_many_chunks(spark, alpha):
    rnd = random.Random(4)
    x = [None, None] + [rnd.random() for _ in range(400)]
    df = spark.createDataFrame([("a", 1, T0 + i * H, v) for i, v in enumerate(x)], "symbol string, segment int, t long, x double").withColumn("open_time", F.timestamp_millis("t"))
    got = {r.t: r.y for r in factors.exponential(df, "x", alpha, "y", min_samples=3, negligible=1e-20).collect()}
    y, n = None, 0
    for i, v in enumerate(x):
        if v is not None:
            y, n = (v if y is None else (1 - alpha) * y + alpha * v), n + 1
        want = y if n >= (3 if alpha < 1 else 1) else None
        assert (got[T0 + i * H] is None) == (want is None) and (want is None or math.isclose(got[T0 + i * H], want, rel_tol=1e-9))


def test_kama_against_its_definition(spark):
    got = values(factors.segment_factor(bars(spark, n=40, symbols=("a",)), "1h", "kama"))
    close = [r.close for r in bars(spark, n=40, symbols=("a",)).orderBy("open_time").collect()]
    level = close[9]
    for i in range(10, 40):
        noise = sum(abs(close[j] - close[j - 1]) for j in range(i - 9, i + 1))
        e = abs(close[i] - close[i - 10]) / noise
        level += (e * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (close[i] - level)
        assert math.isclose(got["a", T0 + (i + 1) * H], close[i] / level - 1, rel_tol=1e-9)


def test_incomplete_bars_are_segments_of_their_own(spark):
    rows = timeaxis.segments(bars(spark, n=6, symbols=("a",), incomplete=(3,)), "1h").orderBy("open_time").collect()
    assert [r.segment for r in rows] == [1, 1, 1, 2, 3, 3]


def test_asof_takes_exact_matches_and_keeps_null_payloads(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, None), ("c", 1, "z")], "k string, u long, v string")
    got = {(r.k, r.t): (r.u, r.v) for r in timeaxis.asof(left, right, "t", "u", ["k"]).collect()}
    assert got == {("a", 5): (5, "x"), ("a", 10): (9, None), ("a", 1): (None, None), ("b", 7): (None, None)}
    strict = {(r.k, r.t): r.u for r in timeaxis.asof(left, right, "t", "u", ["k"], strict=True).collect()}
    assert strict["a", 5] is None and strict["a", 10] == 9


def test_expressions_divide_by_zero_as_sql_does(spark):
    """Infinite where the low is 0, NaN where all prices are; before, the whole query failed."""
    from crosspan.functions.core import quotient

    prices = {0: (4.0, 6.0, 0.0, 5.0), 1: (4.0, 6.0, 0.0, 4.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (4.0, 6.0, 2.0, 5.0)}
    rows = [("a", T0 + i * H, *p) for i, p in prices.items()]
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double").withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + H), "is_complete": F.lit(True)})
    build = lambda b: F.log(quotient(F.col("high"), F.col("low"))) * F.abs(F.col("close") - F.col("open"))
    got = [v for _, v in sorted(values(factors.expression_factor(df, "1h", build)).items())]
    assert got[0] == math.inf and math.isnan(got[1]) and math.isnan(got[2]) and math.isclose(got[3], math.log(3))


def test_the_expression_query_reads_bars_with_a_low_of_zero(spark, tmp_path):
    import duckdb

    from crosspan.plans import factor_queries

    rows = [(i, T0 // 1000 + i * 600, i % 3, "view", 0.0 if i in (7, 50) else 1.0 + i % 11) for i in range(150)]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.expr("timestamp_seconds(s)").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("e1_expression", "e2_rolling", "e5_direction"):
        want = sorted(db.sql(f"select symbol, t, value from ({factor_queries.SQL[name]})").fetchall())
        got = sorted(tuple(r) for r in factor_queries.QUERIES[name](spark, str(tmp_path)).select("symbol", "t", "value").collect())
        assert got == want and (name != "e1_expression" or any(v == math.inf for _, _, v in got))
