"""Windows of blocks against Spark's own sliding frames, and their time."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspan.functions import rolling
from crosspan.functions.rolling import Windows


def series(spark, n=700, seed=1):
    rnd = random.Random(seed)
    rows = [(s, i, None if rnd.random() < 0.05 else 5.0 if 200 < i < 330 else rnd.gauss(1e6, 3), None if rnd.random() < 0.02 else rnd.random()) for s in "abc" for i in range(n if s != "c" else 3)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, open_time long, x double, y double")


def kinds(n):
    x, y = F.col("x"), F.col("y")
    both = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-(n - 1), 0)
    corr = F.try_divide(F.covar_pop(*both).over(w), F.sqrt(F.var_pop(both[0]).over(w) * F.var_pop(both[1]).over(w)))
    return {
        "total": (rolling.total(x), F.sum(x).over(w)), "counted": (rolling.counted(x), F.count(x).over(w)), "lowest": (rolling.lowest(x), F.min(x).over(w)), "highest": (rolling.highest(x), F.max(x).over(w)),
        "mean": (rolling.mean(x), F.avg(x).over(w)), "sample": (rolling.deviation(x, 1), F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w))), "population": (rolling.deviation(x, 0), F.stddev_pop(x).over(w)),
        "correlation": (rolling.correlation(x, y), corr), "whole": (rolling.whole(rolling.mean(y), y, n), F.when(F.count(y).over(w) == n, F.avg(y).over(w))),
    }


@pytest.mark.parametrize("n", [1, 2, 7, 100, 333, 2000])
def test_blocks_equal_sliding_frames(spark, monkeypatch, n):
    monkeypatch.setattr(rolling, "DIRECT", 0)
    df, wanted = rolling.numbered(series(spark), ("symbol",)), kinds(n)
    got = rolling.rolled(df, {name: (k, n) for name, (k, _) in wanted.items()}, ("symbol",)).withColumns({f"{name}_": c for name, (_, c) in wanted.items()})
    seen = dict.fromkeys(wanted, 0)
    for r in got.collect():
        for name in wanted:
            a, b = r[name], r[f"{name}_"]
            assert (a is None) == (b is None), (name, r)
            assert a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (name, r)
            seen[name] += a is not None
    assert seen["total"] > 1000 and (n < 2 or seen["correlation"] > 900)


def test_values_of_values(spark, monkeypatch):
    monkeypatch.setattr(rolling, "DIRECT", 3)
    w = Windows(("symbol",))
    value = w.lag(w.mean(w.lag(F.col("y"), 2), 5), 1) + w.sum(F.col("y"), 2)
    rows = sorted(w.added(series(spark)).select("symbol", "open_time", "y", value.alias("v")).collect(), key=lambda r: (r.symbol, r.open_time))
    ys = {(r.symbol, r.open_time): r.y for r in rows}
    found = 0
    for r in rows:
        y = [ys.get((r.symbol, r.open_time - k)) for k in range(8)]
        want = None if None in y[3:8] or None in y[:2] else sum(y[3:8]) / 5 + y[0] + y[1]
        assert (r.v is None) == (want is None) and (want is None or math.isclose(r.v, want, rel_tol=1e-12))
        found += want is not None
    assert found > 500


@pytest.mark.parametrize("width", [1, 10, 97, 5000])
def test_spans_of_time(spark, width):
    rnd = random.Random(width)
    rows = [("a", rnd.randrange(-500, 900), rnd.choice([None, rnd.random()])) for _ in range(400)] + [("b", 5, 1.0)]
    times = [("a", rnd.randrange(-700, 1200)) for _ in range(200)] + [("b", 4), ("b", 5), ("c", 5)]
    out = rolling.at_times(spark.createDataFrame(rows, "symbol string, t long, v double"), spark.createDataFrame(times, "symbol string, t long"), width, {"s": rolling.total(F.col("v")), "n": rolling.counted(F.col("v")), "low": rolling.lowest(F.col("v"))})
    got = {(r.symbol, r.t): (r.s, r.n, r.low) for r in out.collect()}
    assert set(got) == set(times)
    for s, t in times:
        own = [v for k, u, v in rows if k == s and t - width < u <= t and v is not None]
        assert got[s, t][1:] == (len(own), min(own, default=None))
        assert (got[s, t][0] is None) == (not own) and (not own or math.isclose(got[s, t][0], sum(own), rel_tol=1e-12))


def test_long_windows_cost_what_short_ones_do(spark):
    """A month of minutes against 100 rows, over one symbol."""
    df = spark.range(120_000).select(F.lit("a").alias("symbol"), F.col("id").alias("open_time"), F.rand(1).alias("x"))
    df.write.format("noop").mode("overwrite").save()

    def took(n):
        best = math.inf
        for _ in range(2):
            start = time.time()
            w = Windows(("symbol",))
            value = w.std(F.col("x"), n) + w.max(F.col("x"), n)
            w.added(df).select(value.alias("v")).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        return best

    short = took(100)
    assert took(43_200) < 2 * short + 1
