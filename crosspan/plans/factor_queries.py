"""Registered queries of the factor families, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import ms, quotient
from crosspan.operators import factors
from crosspan.plans import sql
from crosspan.sources import panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def told(df: DataFrame) -> DataFrame:
    """(symbol, t, value) with values rounded once."""
    return df.where("raw_value is not null").select("symbol", ms("timestamp").alias("t"), F.round("raw_value", 6).alias("value"))


def answer(kind: str, ctes: list[str], value: str, source: str, windows: str = "") -> str:
    return f"WITH {', '.join([sql.bars(kind), *ctes])}\nSELECT symbol, t + {sql.STEP[kind]} AS t, round(v, 6) AS value FROM (SELECT symbol, t, {value} AS v FROM {source} {windows}) WHERE v IS NOT NULL"


# ------------------------------------------------------------------------------- family F


def over_symbol(n: int) -> str:
    """Windows of the symbol's last n and n + 1 bars."""
    return f"WINDOW w AS (PARTITION BY symbol ORDER BY t), wn AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), wm AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def f_query(name: str, kind: str, make: Callable[[DataFrame], DataFrame], value: str, n: int, ctes: tuple[str, ...] = (), source: str = "bars") -> None:
    QUERIES[name] = lambda spark, sf: told(make(panel.bars(spark, sf, kind)))
    SQL[name] = answer(kind, list(ctes), value, source, over_symbol(n))


WHOLE = "sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER wm = {m} AND t - lag(t, {n}) OVER w = {gap}"


def whole(n: int, kind: str = "1h") -> str:
    return WHOLE.format(n=n, m=n + 1, gap=n * sql.STEP[kind])


f_query("f1_momentum", "1h", lambda b: factors.momentum(b, "1h", "3h"), f"CASE WHEN {whole(3)} AND close > 0 AND lag(close, 3) OVER w > 0 THEN close / lag(close, 3) OVER w - 1 END", 3)
f_query("f2_reversal", "1h", lambda b: factors.momentum(b, "1h", "3h", reverse=True), f"CASE WHEN {whole(3)} AND close > 0 AND lag(close, 3) OVER w > 0 THEN -(close / lag(close, 3) OVER w - 1) END", 3)
QUERIES["f1_momentum_skip"] = lambda spark, sf: told(factors.momentum(panel.bars(spark, sf, "6h"), "6h", "24h", "12h"))
SQL["f1_momentum_skip"] = answer("6h", [], f"CASE WHEN sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) = 5 AND lag(t, 2) OVER w - lag(t, 6) OVER w = {4 * sql.STEP['6h']} THEN lag(close, 2) OVER w / lag(close, 6) OVER w - 1 END", "bars", "WINDOW w AS (PARTITION BY symbol ORDER BY t)")
RET = "ret AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars)"
f_query("f3_volatility", "1h", lambda b: factors.volatility(b, "1h", "4h"), f"CASE WHEN {whole(4)} AND count(r) OVER wn = 4 THEN stddev_pop(r) OVER wn END", 4, (RET,), "ret")
f_query("f4_quote_volume", "1h", lambda b: factors.quote_volume(b, "1h", "4h"), f"CASE WHEN sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER wn = 4 AND t - lag(t, 3) OVER w = {3 * sql.HOUR} THEN sum(quote_volume) OVER wn END", 4)
f_query("f5_taker_ratio", "1h", lambda b: factors.taker_ratio(b, "1h", "4h"), f"CASE WHEN sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER wn = 4 AND t - lag(t, 3) OVER w = {3 * sql.HOUR} AND sum(quote_volume) OVER wn > 0 THEN sum(taker_buy_quote_volume) OVER wn / sum(quote_volume) OVER wn END", 4)
f_query("f6_illiquidity", "1h", lambda b: factors.illiquidity(b, "1h", "4h"), f"CASE WHEN {whole(4)} AND count(a) OVER wn = 4 THEN avg(a) OVER wn END", 4, (RET, "amihud AS (SELECT *, abs(r) / quote_volume * 1e6 AS a FROM ret)"), "amihud")
# Windows of more rows than Spark's sliding frames are used for.
f_query("f3_volatility_long", "6h", lambda b: factors.volatility(b, "6h", "10d"), f"CASE WHEN {whole(40, '6h')} AND count(r) OVER wn = 40 THEN stddev_pop(r) OVER wn END", 40, (RET,), "ret")
f_query("f6_illiquidity_long", "6h", lambda b: factors.illiquidity(b, "6h", "9d"), f"CASE WHEN {whole(36, '6h')} AND count(a) OVER wn = 36 THEN avg(a) OVER wn END", 36, (RET, "amihud AS (SELECT *, abs(r) / quote_volume * 1e6 AS a FROM ret)"), "amihud")
SAMPLED = " AND ".join(f"lag(is_complete, {n}) OVER w AND lag(close, {n}) OVER w > 0 AND t - lag(t, {n}) OVER w = {n * sql.STEP['6h']}" for n in (0, 2, 4))
MEAN = "((close + lag(close, 2) OVER w + lag(close, 4) OVER w) / 3)"
f_query("f7_sampled_mean", "6h", lambda b: factors.sampled_mean(b, "6h", "12h", 3), f"CASE WHEN {SAMPLED} THEN close / {MEAN} - 1 END", 2)
f_query("f8_sampled_mean_inverse", "6h", lambda b: factors.sampled_mean(b, "6h", "12h", 3, True), f"CASE WHEN {SAMPLED} THEN -(close / {MEAN} - 1) END", 2)

QUERIES["f9_live_ema_ratio"] = lambda spark, sf: told(factors.live_ema_ratio(panel.bars(spark, sf, "6h"), "6h", "1d", 2, 4))
SQL["f9_live_ema_ratio"] = f"""WITH {sql.bars("6h")},
b AS (SELECT *, t - t % {sql.DAY} AS bucket FROM bars),
candle AS (SELECT symbol, bucket AS t, last(close ORDER BY t) AS close, count(*) = 4 AND bool_and(is_complete) AND last(close ORDER BY t) > 0 AS is_complete FROM b GROUP BY symbol, bucket),
{sql.segments("1d", "candle").replace("lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(volume) OVER w AS v1, ", "")},
good AS (SELECT symbol, segment, t, close FROM seg WHERE is_complete),
{sql.average("good", "close", 2 / 3, "fast", 1, "a1")}, {sql.average("a1", "close", 2 / 5, "slow", 1, "a2")},
prior AS (SELECT symbol, t + {sql.DAY} AS bucket, fast, slow, row_number() OVER (PARTITION BY symbol, segment ORDER BY t) AS n FROM a2),
live AS (SELECT b.*, p.fast, p.slow, coalesce(p.n, 0) AS n, count(*) OVER w AS sofar, sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER w AS whole, (b.t + {sql.STEP['6h']} - b.bucket) // {sql.STEP['6h']} AS expected
 FROM b LEFT JOIN prior p ON b.symbol = p.symbol AND b.bucket = p.bucket WINDOW w AS (PARTITION BY b.symbol, b.bucket ORDER BY b.t))
SELECT symbol, t + {sql.STEP['6h']} AS t, round((2.0 / 3 * close + (1 - 2.0 / 3) * fast) / (2.0 / 5 * close + (1 - 2.0 / 5) * slow) - 1, 6) AS value FROM live
WHERE is_complete AND sofar = expected AND whole = expected AND n + 1 >= 4 AND n > 0"""

# -------------------------------------------------------------------------- families G and K


def over_segment(*sizes: int) -> str:
    named = "".join(f", w{n} AS (PARTITION BY symbol, segment ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)
    return "WINDOW w AS (PARTITION BY symbol, segment ORDER BY t)" + named


def s_query(key: str, name: str, value: str, *sizes: int, ctes: tuple[str, ...] = (), source: str = "seg") -> None:
    QUERIES[f"{key}_{name}"] = lambda spark, sf: told(factors.segment_factor(panel.bars(spark, sf, "6h"), "6h", name))
    SQL[f"{key}_{name}"] = answer("6h", [sql.segments("6h"), *ctes], f"CASE WHEN is_complete THEN {value} END", source, over_segment(*sizes))


def has(n: int, c: str = "close") -> str:
    return f"count({c}) OVER w{n} = {n}"


def mean_gap(n: int) -> str:
    return f"CASE WHEN {has(n)} THEN (close - avg(close) OVER w{n}) / avg(close) OVER w{n} * 100 END"


s_query("g1", "alpha18", "close / lag(close, 5) OVER w")
s_query("g2", "alpha20", "(close - lag(close, 6) OVER w) / lag(close, 6) OVER w * 100")
s_query("g4", "alpha31", mean_gap(12), 12)
s_query("g4", "alpha66", mean_gap(6), 6)
s_query("g4", "alpha71", mean_gap(24), 24)
UP, DOWN = "sum(CASE WHEN close > c1 THEN volume ELSE 0 END) OVER w26", "sum(CASE WHEN close <= c1 THEN volume ELSE 0 END) OVER w26"
s_query("g5", "alpha40", f"CASE WHEN {has(26)} AND {DOWN} > 0 THEN {UP} / {DOWN} * 100 END", 26)
s_query("g6", "alpha53", f"CASE WHEN {has(12, 'ch')} THEN sum(CASE WHEN ch > 0 THEN 1.0 ELSE 0.0 END) OVER w12 / 12 * 100 END", 12)
s_query("g7", "alpha88", "(close - lag(close, 20) OVER w) / lag(close, 20) OVER w * 100")


def net_strength(n: int, scale: str) -> str:
    up, down = f"sum(CASE WHEN ch > 0 THEN ch ELSE 0 END) OVER w{n}", f"sum(CASE WHEN ch < 0 THEN -ch ELSE 0 END) OVER w{n}"
    return f"CASE WHEN {has(n)} AND {up} + {down} > 0 THEN ({up} - {down}) / ({up} + {down}) * {scale} END"


s_query("g9", "alpha112", net_strength(12, "100"), 12)
DIFF = "dif AS (SELECT *, close - lag(close, {n}) OVER (PARTITION BY symbol, segment ORDER BY t) AS x FROM seg)"
s_query("g3", "alpha24", "y", ctes=(DIFF.format(n=5), sql.average("dif", "x", 1 / 5, "y", 5, "a1")), source="a1")
s_query("g10", "alpha151", "y", ctes=(DIFF.format(n=20), sql.average("dif", "x", 1 / 20, "y", 20, "a1")), source="a1")
s_query("g8", "alpha89", "2 * (d - s)", ctes=(sql.average("seg", "close", 2 / 13, "fast", 13, "a1"), sql.average("a1", "close", 2 / 27, "slow", 27, "a2"), "a3 AS (SELECT *, fast - slow AS d FROM a2)", sql.average("a3", "d", 2 / 10, "s", 10, "a4")), source="a4")

FIT = f"regr_slope(close, i::DOUBLE) OVER w10"
s_query("k1", "trend", f"CASE WHEN {has(10)} THEN {FIT} / close END", 10)
s_query("k2", "signed_fit", f"CASE WHEN {has(10)} AND var_pop(close) OVER w10 > 0 THEN regr_r2(close, i::DOUBLE) OVER w10 * sign({FIT}) END", 10)
s_query("k3", "range_position", f"CASE WHEN {has(10)} AND max(high) OVER w10 > min(low) OVER w10 THEN (close - min(low) OVER w10) / (max(high) OVER w10 - min(low) OVER w10) END", 10)
s_query("k4", "extreme_times", f"CASE WHEN {has(10)} THEN (list_position(list(high) OVER w10, max(high) OVER w10) - list_position(list(low) OVER w10, min(low) OVER w10)) / 10.0 END", 10)
s_query("k5", "persistence", f"CASE WHEN {has(10, 'ch')} THEN avg(CASE WHEN ch > 0 THEN 1.0 ELSE 0.0 END) OVER w10 - avg(CASE WHEN ch < 0 THEN 1.0 ELSE 0.0 END) OVER w10 END", 10)
s_query("k6", "strength", net_strength(10, "1"), 10)
s_query("k7", "roc_momentum", "close / lag(close, 10) OVER w - 1")
PV = "pv AS (SELECT *, close / c1 AS x, ln(volume / v1 + 1) AS y FROM seg)"
s_query("k8", "price_volume_corr", f"CASE WHEN {has(10, 'y')} AND var_pop(x) OVER w10 > 0 AND var_pop(y) OVER w10 > 0 THEN corr(x, y) OVER w10 END", 10, ctes=(PV,), source="pv")
s_query("k9", "trix", "CASE WHEN lag(e3) OVER w > 0 THEN (e3 / lag(e3) OVER w - 1) * 100 END", ctes=(sql.average("seg", "close", 2 / 6, "e1", 5, "a1"), sql.average("a1", "e1", 2 / 6, "e2", 5, "a2"), sql.average("a2", "e2", 2 / 6, "e3", 5, "a3")), source="a3")
s_query("k10", "tsi", "CASE WHEN d2 > 0 THEN n2 / d2 * 100 END", ctes=("ab AS (SELECT *, abs(ch) AS ac FROM seg)", sql.average("ab", "ch", 2 / 9, "n1", 8, "a1"), sql.average("a1", "n1", 2 / 5, "n2", 4, "a2"), sql.average("a2", "ac", 2 / 9, "d1", 8, "a3"), sql.average("a3", "d1", 2 / 5, "d2", 4, "a4")), source="a4")
ROCS = "rocs AS (SELECT *, " + ", ".join(f"close / lag(close, {r}) OVER w - 1 AS r{r}" for r in (4, 6, 8, 10)) + " FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY t))"
s_query("k11", "kst", f"CASE WHEN {has(6, 'r10')} THEN (avg(r4) OVER w4 + 2 * avg(r6) OVER w4 + 3 * avg(r8) OVER w4 + 4 * avg(r10) OVER w6) * 100 END", 4, 6, ctes=(ROCS,), source="rocs")
QUERIES["k12_kama"] = lambda spark, sf: told(factors.segment_factor(panel.bars(spark, sf, "6h"), "6h", "kama"))
SQL["k12_kama"] = f"""WITH RECURSIVE {sql.bars("6h")}, {sql.segments("6h")},
kp AS (SELECT symbol, segment, t, i, close, abs(close - lag(close, 10) OVER w) AS dir, sum(abs(ch)) OVER (w ROWS 9 PRECEDING) AS noise FROM seg WHERE is_complete WINDOW w AS (PARTITION BY symbol, segment ORDER BY t)),
lv AS (SELECT symbol, segment, t, i, close, close AS l, 0.0::DOUBLE AS noise FROM kp WHERE i = 10
 UNION ALL SELECT k.symbol, k.segment, k.t, k.i, k.close, CASE WHEN k.noise > 0 THEN lv.l + pow(k.dir / k.noise * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2) * (k.close - lv.l) ELSE lv.l END, k.noise FROM lv JOIN kp k ON k.symbol = lv.symbol AND k.segment = lv.segment AND k.i = lv.i + 1)
SELECT symbol, t + {sql.STEP["6h"]} AS t, round(close / l - 1, 6) AS value FROM lv WHERE i > 10 AND noise > 0"""
s_query("k13", "vortex", f"CASE WHEN {has(10, 'c1')} THEN (sum(abs(high - l1)) OVER w10 - sum(abs(low - h1)) OVER w10) / nullif(sum(greatest(high - low, abs(high - c1), abs(low - c1))) OVER w10, 0) END", 10)
s_query("k14", "price_volume_trend", f"CASE WHEN {has(10, 'c1')} AND sum(volume) OVER w10 > 0 THEN sum(volume * (close / c1 - 1)) OVER w10 / sum(volume) OVER w10 END", 10)

# ------------------------------------------------------------------------------- family E


def e_query(name: str, build: Callable, value: str, *sizes: int, direction: int = 1) -> None:
    QUERIES[name] = lambda spark, sf: told(factors.expression_factor(panel.bars(spark, sf, "6h"), "6h", build, direction))
    SQL[name] = answer("6h", [sql.segments("6h")], f"CASE WHEN is_complete THEN {value} END", "seg", over_segment(*sizes))


e_query("e1_expression", lambda b: F.log(quotient(F.col("high"), F.col("low"))) * F.abs(F.col("close") - F.col("open")), "ln(high / low) * abs(close - open)")
e_query("e2_rolling", lambda b: quotient(b.std(F.col("close"), 5), b.mean(F.col("close"), 5)) + quotient(b.max(F.col("high"), 5) - b.min(F.col("low"), 5), b.sum(F.col("quote_volume"), 5)) - quotient(b.lag(F.col("close"), 2), F.col("close")), f"CASE WHEN {has(5)} THEN stddev_samp(close) OVER w5 / avg(close) OVER w5 + (max(high) OVER w5 - min(low) OVER w5) / sum(quote_volume) OVER w5 - lag(close, 2) OVER w / close END", 5)
e_query(
    "e2_rolling_long",
    lambda b: quotient(b.std(F.col("close"), 48), b.mean(F.col("close"), 48)) + quotient(b.max(F.col("high"), 36) - b.min(F.col("low"), 36), b.sum(F.col("quote_volume"), 36)) + b.corr(F.col("close"), F.col("volume"), 40),
    f"CASE WHEN {has(48)} THEN stddev_samp(close) OVER w48 / avg(close) OVER w48 + (max(high) OVER w36 - min(low) OVER w36) / sum(quote_volume) OVER w36 + corr(close, volume) OVER w40 END", 36, 40, 48,
)
e_query("e5_direction", lambda b: quotient(F.col("close"), b.mean(F.col("close"), 4)) - 1, f"CASE WHEN {has(4)} THEN -(close / (avg(close) OVER w4) - 1) END", 4, direction=-1)
QUERIES["e3_ema"] = lambda spark, sf: told(factors.raw(factors.span_average(factors.prepared(panel.bars(spark, sf, "6h"), "6h"), "close", 6, "y"), F.when(F.col("is_complete"), F.col("y"))))
SQL["e3_ema"] = answer("6h", [sql.segments("6h"), sql.average("seg", "close", 2 / 7, "y", 6, "a1")], "CASE WHEN is_complete THEN y END", "a1")
