"""Raw payloads, publishing, universes and quality on small inputs."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crosspan.functions.core import FINER, bars_in, seconds
from crosspan.operators import quality, timeaxis, universe
from crosspan.sources import files, panel

H, D = 3_600_000, 86_400_000
T0 = 1704067200000


def line(t=T0, **over):
    cells = {"t": t, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "ct": t + H - 1, "q": "15", "n": "3", "tb": "4", "tq": "6", "x": "0"} | over
    return ",".join(str(v) for v in cells.values())


def test_csv_klines_split_good_rows_from_rejects(spark):
    lines = ["open_time,open", line(), line(T0 + H, c="NaN"), line(T0 + 2 * H, n="2.5"), line(T0 + 3 * H, ct=T0 + 3 * H), line(t=99999999999999999), line(T0 + 4 * H, q="inf")]
    df = spark.createDataFrame([(x, "BTC") for x in lines], "value string, symbol string")
    good, bad = files.csv_klines(df, "1h", "v1")
    row = good.collect()
    assert len(row) == 1 and row[0].close == 1.5 and row[0].is_complete and good.select(F.unix_millis("close_time")).first()[0] == T0 + H
    assert bad.count() == 5


def test_json_klines_know_if_they_had_closed(spark):
    import json

    payload = json.dumps([line(T0).split(","), line(T0 + H).split(",")])
    df = spark.createDataFrame([(payload, "A"), ("[]", "B"), (None, "C")], "value string, symbol string")
    good, _ = files.json_klines(df, "1h", "v1", F.timestamp_millis(F.lit(T0 + H)))
    assert [r.is_complete for r in good.orderBy("open_time").collect()] == [True, False]


def test_publish_refuses_to_overwrite(spark, tmp_path):
    good, _ = files.csv_klines(spark.createDataFrame([(line(), "BTC")], "value string, symbol string"), "1h", "v1")
    files.publish(good, str(tmp_path / "bars"))
    with pytest.raises(AnalysisException):
        files.publish(good, str(tmp_path / "bars"))
    got = files.scan(spark, str(tmp_path / "bars"), files.BARS, "v1", "open_time", F.timestamp_millis(F.lit(T0)), F.timestamp_millis(F.lit(T0 + H)), "1h", ["symbol", "close"])
    assert [tuple(r) for r in got.collect()] == [("BTC", 1.5)]


def daily(spark, days, symbol="a"):
    df = spark.createDataFrame([(symbol, T0 + d * D, 100.0, True) for d in days], "symbol string, t long, quote_volume double, is_complete boolean")
    return df.withColumns({"open_time": F.timestamp_millis("t"), "close_time": F.timestamp_millis(F.col("t") + D)}).drop("t")


def snapshots(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, t long, contract_type string, status string, quote_asset string, margin_asset string, o long, d long")
    return df.select("symbol", F.timestamp_millis("t").alias("snapshot_time"), "contract_type", "status", "quote_asset", "margin_asset", F.timestamp_millis("o").alias("onboard_time"), F.timestamp_millis("d").alias("delivery_time"))


def test_universe_windows_move_with_the_schedule(spark):
    start = T0 + D - (T0 + D) % D
    rows = [("a", T0 - D, "PERPETUAL", "TRADING", "USDT", "USDT", T0 - 9 * D, None), ("b", T0 - D, "perpetual", "BREAK", "USDT", "USDT", T0, None), ("c", T0 + 2 * D, "PERPETUAL", "TRADING", "USDT", "USDT", T0 + 3 * D, T0 + 5 * D)]
    rules = universe.Rules(volume_window="2d", min_quote_volume=50.0, missing_window="2d")
    u = universe.build(daily(spark, [0, 1, 2]), snapshots(spark, rows), start, start + 7 * D, "1d", "1d", rules)
    got = {(r.symbol, (r.t - T0) // D): (r.reason_code, r.rolling_quote_volume, r.missing_ratio) for r in u.select("symbol", F.unix_millis("timestamp").alias("t"), "reason_code", "rolling_quote_volume", "missing_ratio").collect()}
    assert [got["a", d] for d in range(1, 7)] == [("ELIGIBLE", 100.0, 0.5), ("ELIGIBLE", 200.0, 0.0), ("ELIGIBLE", 200.0, 0.0), ("ELIGIBLE", 100.0, 0.5), ("ILLIQUID", 0.0, 1.0), ("ILLIQUID", 0.0, 1.0)]
    assert got["b", 2][0] == "NOT_TRADING"
    assert [got["c", d][0] for d in range(1, 7)] == ["NO_CONTRACT_SNAPSHOT", "NOT_LISTED", "ILLIQUID", "ILLIQUID", "DELISTED", "DELISTED"]


def test_quality_on_empty_and_broken_bars(spark):
    bars = spark.createDataFrame([("a", "1h", T0, 1.0, 0.5, 2.0, None, -1.0, float("nan"), 5.0, 1.0, -1)], "symbol string, interval string, t long, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_volume double, taker_buy_quote_volume double, trades long").withColumn("open_time", F.timestamp_millis("t"))
    r = quality.checks(bars).first()
    assert (r.null_close, r.non_finite_quote_volume, r.bad_ohlc, r.negative_volume, r.taker_over_volume, r.negative_trades) == (1, 1, 1, 1, 1, 1)
    empty = bars.where("false")
    assert quality.checks(empty).first().rows == 0 and quality.duplicate_keys(empty).first()[0] == 0
    assert quality.gate(quality.checks(empty), {"bad_ohlc": 0}).first().passed


def test_durations():
    assert seconds("15m") == 900 and bars_in("1d", "6h") == 4
    for bad in ("0m", "1M", "m", "-1h"):
        with pytest.raises(ValueError):
            seconds(bad)
    with pytest.raises(ValueError):
        bars_in("5h", "2h")


def test_damaged_lines_are_rejects_and_headers_are_not(spark):
    good = "1704067200000,1,2,0.5,1.5,10,1704070799999,15,3,5,7,0"
    lines = ["open_time,open,high,low,close", good, "x" + good, good.replace("1704067200000", ""), "", good.replace(",2,", ",n/a,")]
    df = spark.createDataFrame([("a", v) for v in lines], "symbol string, value string")
    bars, rejects = files.csv_klines(df, "1h", "v1")
    assert bars.count() == 1 and rejects.count() == 3


def test_unreadable_settlements_and_contracts_are_rejects(spark):
    hours = spark.createDataFrame([("a", 8)], "symbol string, funding_interval_hours int")
    rows = [("a", "1704067200000", "0.1", "5"), ("a", "later", "0.1", None), ("a", "1704067200000", "NaN", None), (None, "1704067200000", "0.1", None), ("a", "1704067200000", "0.1", "much")]
    good, bad = files.csv_funding(spark.createDataFrame(rows, "symbol string, calc_time string, last_funding_rate string, markPrice string"), hours, "v1")
    assert [(r.symbol, r.funding_rate, r.mark_price, r.funding_interval_hours) for r in good.collect()] == [("A", 0.1, 5.0, 8)] and bad.count() == 4
    text = '{"symbols": [{"symbol": "x", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.1"}, {"filterType": "LOT_SIZE", "stepSize": "1", "minQty": "1"}]}, {"symbol": "y", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.1"}]}, {"symbol": "z"}]}'
    good, bad = files.contract_rows(spark.createDataFrame([(text,)], "value string").selectExpr("value", "timestamp_millis(0) as snapshot_time"), "v1")
    assert [r.symbol for r in good.collect()] == ["X"] and sorted(r.symbol for r in bad.collect()) == ["Y", "Z"]


def test_no_payload_and_no_line_vanishes(spark):
    """What can't be read is a reject, one a payload or line; headers and empty lines hold nothing."""
    good = '[["1704067200000","1","2","0.5","1.5","10","1704070799999","15","3","5","7","0"]]'
    pages = spark.createDataFrame([("A", good), ("A", good[:-1]), ("B", "no json"), ("C", None), ("D", "[]"), ("E", '{"code": -1}')], "symbol string, value string")
    bars, rejects = files.json_klines(pages, "1h", "v1", F.timestamp_millis(F.lit(2_000_000_000_000)))
    assert [r.symbol for r in bars.collect()] == ["A"] and sorted(r.symbol for r in rejects.collect()) == ["A", "B", "C", "E"]
    hours = spark.createDataFrame([("A", 8)], "symbol string, funding_interval_hours int")
    paid = spark.createDataFrame([('[{"symbol":"A","fundingTime":"1704067200000","fundingRate":"0.1"}]',), ("[{",), (None,), ("x",)], "value string")
    settled, rejects = files.funding_rows(paid, hours, "v1")
    assert settled.count() == 1 and rejects.count() == 3
    meta = spark.createDataFrame([(1, '{"symbols": []}'), (2, '{"symbols": [{'), (3, "{}"), (4, None), (5, "gone")], "k int, value string").withColumn("snapshot_time", F.timestamp_seconds("k"))
    contracts, rejects = files.contract_rows(meta, "v1")
    assert contracts.count() == 0 and sorted(r.snapshot_time.timestamp() for r in rejects.collect()) == [2, 3, 4, 5]
    line = "1704067200000,1,2,0.5,1.5,10,1704070799999,15,3,5,7,0"
    lines = spark.createDataFrame([("A", x) for x in (line, "open_time,open,high", "Open Time,Open,High,Low,Close", "", "  ", "n/a,,,", "damaged", "open24h,x,close")], "symbol string, value string")
    bars, rejects = files.csv_klines(lines, "1h", "v1")
    assert bars.count() == 1 and sorted(r._raw for r in rejects.collect()) == ['["damaged"]', '["n/a","","",""]']


@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_stretches_of_time(spark, strict):
    """A key's rows in many windows give what one window gives, with nothing before, gaps and nulls."""
    import random

    rnd = random.Random(2)
    left = spark.createDataFrame([(k, rnd.choice("ab"), rnd.randrange(-3, 400)) for k in range(300)] + [(900, "c", 5), (901, None, 7)], "id long, symbol string, s long").withColumn("t", F.timestamp_seconds(F.col("s") * 3600))
    times = [(s, t) for s in "ab" for t in range(40, 400) if rnd.random() < 0.1 and not 150 < t < 260]
    right = spark.createDataFrame([(s, t, rnd.choice([None, float(t)])) for s, t in times], "symbol string, r long, v double").withColumn("u", F.timestamp_seconds(F.col("r") * 3600)).drop("r")
    one, many = (sorted(map(repr, timeaxis.asof(left, right, "t", "u", ["symbol"], strict, every=e).collect())) for e in (None, "1d"))
    assert one == many and len(one) == 302


def test_a_panel_published_by_symbol_needs_no_exchange(spark, tmp_path):
    from crosspan.operators import factors

    good, _ = files.csv_klines(spark.createDataFrame([(line(T0 + i * 31 * H), s) for i in range(60) for s in "abcde"], "value string, symbol string"), "1h", "v1")
    path = str(tmp_path / "bars")
    files.publish_by_symbol(good, path, 3)
    with pytest.raises(AnalysisException):
        files.publish_by_symbol(good, path, 3)
    at = lambda i: F.timestamp_millis(F.lit(T0 + i * 31 * H))
    back = files.scan_by_symbol(spark, path, 3, "v1", at(2), at(50), "1h")
    assert sorted(map(str, back.collect())) == sorted(map(str, good.where((F.col("open_time") >= at(2)) & (F.col("open_time") < at(50))).select(*back.columns).collect()))
    jobs = {"t1": timeaxis.segments(back, "1h"), "f1": factors.momentum(back, "1h", "2h"), "u1": universe.running_history(back), "r1": factors.exponential(back.withColumn("segment", F.lit(1)), "close", 0.3, "y")}
    plain = {"t1": timeaxis.segments(good, "1h"), "u1": universe.running_history(good)}
    for name, df in jobs.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan, name
        assert df.count() == 240
        if name in plain:
            assert "Exchange" in plain[name]._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("passing_")]
    one = files.scan_by_symbol(spark, path, 3, "v1", at(0), at(1), "1h", ["symbol", "close"])
    assert one.count() == 5 and "month" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_contracts_are_joined_and_aggregated_in_small_tasks(spark, tmp_path):
    """Orders are dealt once, by customer and finer than other shuffles, and aggregated where they are."""
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'P' as o_orderstatus", "timestamp'2024-01-03' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id as c_custkey", "'MACHINERY' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    contracts = panel.contracts(spark, str(tmp_path))
    dealt = [x for x in contracts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert len(dealt) == 1 and f", {FINER * int(spark.conf.get('spark.sql.shuffle.partitions'))})" in dealt[0]
    assert sorted((r.symbol, r.status, r.quote_asset) for r in contracts.collect()) == [(str(k), "BREAK", "BUSD") for k in range(5)]


def test_universe_sorts_no_row_for_each_symbol_and_time(spark):
    """Bars are summed by slot before the one window that carries snapshots; no symbol is crossed with the schedule
    beforehand, and no window is over single bars."""
    start = T0 + 3 * D
    rules = universe.Rules(volume_window="2d", min_quote_volume=50.0, missing_window="2d")
    u = universe.build(daily(spark, [0, 1, 2]), snapshots(spark, [("a", T0, "PERPETUAL", "TRADING", "USDT", "USDT", T0, None)]), start, start + 7 * D, "1d", "1d", rules)
    plan = u._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2 and plan.count("\nWindow") + plan.count("+- Window") + plan.count(":- Window") == 2


def test_universe_over_long_and_uneven_windows(spark):
    """Windows longer and shorter than the schedule's step, rows before and after the schedule, against plain sums."""
    import random

    rnd = random.Random(5)
    start, end = T0 + 32 * D, T0 + 62 * D
    held = {s: sorted(rnd.sample(range(0, 70), n)) for s, n in (("a", 40), ("b", 12), ("c", 1))} | {"late": [66, 68], "early": [1, 2]}
    rows = [(s, T0 + i * D, float(i + 1), rnd.random() < 0.8) for s, days in held.items() for i in days]
    bars = spark.createDataFrame(rows, "symbol string, t long, quote_volume double, is_complete boolean").select("symbol", F.timestamp_millis("t").alias("open_time"), F.timestamp_millis(F.col("t") + D).alias("close_time"), "quote_volume", "is_complete")
    none = spark.createDataFrame([], "symbol string, snapshot_time timestamp, contract_type string, status string, quote_asset string, margin_asset string, onboard_time timestamp, delivery_time timestamp")
    for volume, missing in (("3d", "5d"), ("12d", "1d"), ("25d", "40d"), ("6h", "10d")):
        rules = universe.Rules(volume_window=volume, missing_window=missing)
        got = {(r.symbol, r.t): (r.history_bars, r.rolling_quote_volume, round(r.missing_ratio, 9), r.reason_code) for r in universe.build(bars, none, start, end, "5d", "1d", rules).withColumn("t", F.unix_millis("timestamp")).collect()}
        w, m = ({"d": D, "h": D // 24}[x[-1]] * int(x[:-1]) for x in (volume, missing))
        assert len(got) == 5 * 6
        for (s, t), value in got.items():
            mine = [(o + D, q) for x, o, q, c in rows if x == s and c]
            have = sum(t - m < c <= t for c, _ in mine)
            assert value == (sum(c <= t for c, _ in mine), sum(q for c, q in mine if t - w < c <= t), round(max(0.0, min(1.0, 1 - have / (m // D))), 9), "NO_CONTRACT_SNAPSHOT"), (s, t, volume)


def test_reasons_of_symbols_known_from_one_side_alone(spark):
    """Symbols with contracts and no bars, and the other way round, have a row for each time; those only without contracts are left out where contracts aren't used."""
    start = T0 + 2 * D
    only = [("b", T0 + 20 * D, "PERPETUAL", "TRADING", "USDT", "USDT", T0, None), ("c", T0 + D, "PERPETUAL", "TRADING", "USDT", "USDT", T0, None)]
    for used, names in ((True, "abc"), (False, "a")):
        u = universe.build(daily(spark, [0, 1, 9]), snapshots(spark, only), start, start + 4 * D, "1d", "1d", universe.Rules(use_contracts=used))
        got = {(r.symbol, r.n): r.reason_code for r in u.withColumn("n", ((F.unix_millis("timestamp") - start) / D).cast("int")).collect()}
        assert sorted(got) == [(s, k) for s in names for k in range(4)]
        if used:
            assert {got["c", k] for k in range(4)} == {"ELIGIBLE"} and {got[s, k] for s in "ab" for k in range(4)} == {"NO_CONTRACT_SNAPSHOT"}
