"""Registered queries of universe, cross-section, label and diagnostic operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import ms, rounded_half
from crosspan.operators import crosssection, factors, research, timeaxis, universe
from crosspan.plans import sql
from crosspan.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
START, DAYS = 1704067200000, 30
END = START + DAYS * sql.DAY


def query(text: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


# ------------------------------------------------------------ the wide daily panel: users by day


def everyone(bars: DataFrame) -> DataFrame:
    """A universe of all bars."""
    return bars.select(F.col("close_time").alias("timestamp"), "symbol", F.lit(True).alias("is_eligible"), F.lit("all").alias("universe_version"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A0 over F1: two-day momentum of users."""
    bars = panel.bars(spark, sf, "1d")
    return factors.factor_panel(factors.momentum(bars, "1d", "2d"), everyone(bars), "1d", "momentum", "f1", "events-v1")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1d")
    return research.forward_returns(bars, everyone(bars), "1d", "1d")


def rounded(df: DataFrame, *columns: str, time: bool = True) -> DataFrame:
    """Times in epoch ms, named columns rounded once."""
    if time:
        df = df.withColumn("t", ms("timestamp")).drop("timestamp")
    return df.withColumns({c: F.round(c, 6) for c in columns})


D = sql.DAY
SCORES = f"""{sql.bars("1d")},
fac AS (SELECT symbol, t + {D} AS t, CASE WHEN t - lag(t, 2) OVER w = {2 * D} AND close > 0 AND lag(close, 2) OVER w > 0 THEN close / lag(close, 2) OVER w - 1 END AS value FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
sc AS (SELECT symbol, t, value, count(*) OVER (PARTITION BY t) AS n FROM fac WHERE value IS NOT NULL)"""
LABELS = f"""lab AS (SELECT symbol, t + {D} AS t, CASE WHEN lead(t) OVER w IS NULL OR lead(t, 2) OVER w IS NULL THEN 'INSUFFICIENT_FUTURE' WHEN lead(t) OVER w <> t + {D} OR lead(t, 2) OVER w <> t + {2 * D} THEN 'GAPPED_FUTURE'
 WHEN lead(open) OVER w <= 0 OR lead(open, 2) OVER w <= 0 THEN 'INVALID_PRICE' END AS why, lead(open, 2) OVER w / lead(open) OVER w - 1 AS r, lead(open) OVER w AS entry_price, lead(open, 2) OVER w AS exit_price, lead(t) OVER w AS et, lead(t, 2) OVER w AS xt
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
al AS (SELECT symbol, t, value, r FROM sc JOIN lab USING (symbol, t) WHERE why IS NULL)"""


@query(f"WITH {SCORES} SELECT symbol, t, round(value, 6) AS value, value IS NOT NULL AS is_valid, CASE WHEN value IS NULL THEN 'INSUFFICIENT_OR_GAPPED_HISTORY' END AS invalid_reason FROM fac")
def a0_factor_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores(spark, sf), "value").select("symbol", "t", "value", "is_valid", "invalid_reason")


def _place(q: float) -> str:
    return f"list_sort(list(value) OVER (PARTITION BY t))[floor({q} * (n - 1) + 0.5)::INT + 1]"


@query(f"WITH {SCORES} SELECT symbol, t, round(greatest(least(value, {_place(0.95)}), {_place(0.05)}), 6) AS value FROM sc")
def c1_winsorize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.winsorize(scores(spark, sf), 0.05, 0.95).where("is_valid"), "value").select("symbol", "t", "value")


AVG_RANK = "(rank() OVER (PARTITION BY t ORDER BY value) + (count(*) OVER (PARTITION BY t, value) - 1) / 2.0)"


@query(f"WITH {SCORES} SELECT symbol, t, round(CASE WHEN n = 1 THEN 0.5 ELSE ({AVG_RANK} - 1) / (n - 1) END, 6) AS value FROM sc")
def c2_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.rank01(scores(spark, sf)).where("is_valid"), "value").select("symbol", "t", "value")


@query(f"WITH {SCORES} SELECT symbol, t, round(CASE WHEN n = 1 THEN 0.5 ELSE ({AVG_RANK} - 1) / (n - 1) END, 6) AS value FROM sc")
def c2_rank_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.rank01(scores(spark, sf), split=True).where("is_valid"), "value").select("symbol", "t", "value")


@query(f"WITH {SCORES}, z AS (SELECT symbol, t, value, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s FROM sc WINDOW p AS (PARTITION BY t)) SELECT symbol, t, round((value - m) / s, 6) AS value FROM z WHERE s > 0")
def c3_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.zscore(scores(spark, sf)).where("is_valid"), "value").select("symbol", "t", "value")


ROBUST = "c AS (SELECT *, median(value) OVER (PARTITION BY t) AS m FROM sc), d AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY t) AS mad FROM c), rz AS (SELECT *, CASE WHEN mad = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (value - m) / (1.4826 * mad))) END AS z FROM d)"


@query(f"WITH {SCORES}, {ROBUST} SELECT symbol, t, round(z, 6) AS z FROM rz")
def c4_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.robust_z(scores(spark, sf).where("is_valid")), "z").select("symbol", "t", "z")


@query(f"WITH {SCORES} SELECT symbol, t, round(({AVG_RANK} - 1) / (n - 1) - 0.5, 6) AS score FROM sc WHERE n > 1")
def c5_midrank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.midrank(scores(spark, sf).where("is_valid")), "score").select("symbol", "t", "score")


@query(f"WITH {SCORES} SELECT symbol, t, (SELECT 1 + count(*) FROM sc b WHERE b.t = a.t AND b.value > a.value) AS bullish, (SELECT 1 + count(*) FROM sc b WHERE b.t = a.t AND b.value < a.value) AS bearish FROM sc a")
def c6_competition_rank(spark: SparkSession, sf: str) -> DataFrame:
    out = crosssection.competition_ranks(scores(spark, sf).where("is_valid"))
    return rounded(out).select("symbol", "t", F.col("bullish").cast("long"), F.col("bearish").cast("long"))


SNAP = "snap AS (SELECT symbol, t, value, n, row_number() OVER (PARTITION BY t ORDER BY value DESC, symbol) AS rk FROM sc)"


@query(f"WITH {SCORES}, {SNAP} SELECT symbol, t, rk AS ordinal_rank, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (rk - 1) / (n - 1)::DOUBLE END, 6) AS percentile_rank, n AS sample_count FROM snap")
def c7_rank_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.rank_snapshots(scores(spark, sf), "momentum"), "percentile_rank").select("symbol", "t", F.col("ordinal_rank").cast("long"), "percentile_rank", F.col("sample_count").cast("long"))


@query(f"WITH {SCORES}, {SNAP} SELECT symbol, t, rk AS ordinal_rank, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (rk - 1) / (n - 1)::DOUBLE END, 6) AS percentile_rank, n AS sample_count FROM snap")
def c7_rank_snapshot_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.rank_snapshots(scores(spark, sf), "momentum", split=True), "percentile_rank").select("symbol", "t", F.col("ordinal_rank").cast("long"), "percentile_rank", F.col("sample_count").cast("long"))


@query(f"WITH {SCORES}, {SNAP} SELECT symbol, t, rk AS ordinal_rank FROM snap WHERE rk <= 10")
def c8_audit_crop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crosssection.crop(crosssection.rank_snapshots(scores(spark, sf), "momentum"), 10)).select("symbol", "t", F.col("ordinal_rank").cast("long"))


@query(f"WITH {SCORES} SELECT s.symbol, s.t, row_number() OVER (PARTITION BY s.t ORDER BY round(s.value, 1) DESC, b.quote_volume DESC, s.symbol) AS ordinal_rank FROM sc s JOIN bars b ON s.symbol = b.symbol AND s.t = b.t + {D}")
def c9_rank_tie_keys(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1d", in_order=True).select(F.col("close_time").alias("timestamp"), "symbol", "quote_volume")
    joined = scores(spark, sf).where("is_valid").join(bars, ["timestamp", "symbol"])
    return rounded(crosssection.ranked_by(joined, "timestamp", F.desc(rounded_half(F.col("value"), 1)), F.desc("quote_volume"), F.asc("symbol"))).select("symbol", "t", F.col("ordinal_rank").cast("long"))


# ------------------------------------------------------------------------- labels and diagnostics


@query(f"WITH {SCORES}, {LABELS} SELECT symbol, t, entry_price, exit_price, et AS entry_t, xt AS exit_t, CASE WHEN why IS NULL THEN round(r, 6) END AS forward_return, why AS invalid_reason FROM lab")
def d1_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(labels(spark, sf), "forward_return")
    return out.select("symbol", "t", "entry_price", "exit_price", ms("entry_time").alias("entry_t"), ms("exit_time").alias("exit_t"), "forward_return", "invalid_reason")


RANKED = f"rx AS (SELECT *, {AVG_RANK} AS x, rank() OVER (PARTITION BY t ORDER BY r) + (count(*) OVER (PARTITION BY t, r) - 1) / 2.0 AS y FROM al)"
IC = f"{RANKED}, ic AS (SELECT t, count(*) AS sample_count, CASE WHEN var_pop(value) > 0 AND var_pop(r) > 0 THEN corr(value, r) END AS ic, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS rank_ic FROM rx GROUP BY t)"


@query(f"WITH {SCORES}, {LABELS}, {IC} SELECT t, sample_count, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ic")
def d2_information_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.information_coefficient(scores(spark, sf), labels(spark, sf)), "ic", "rank_ic")


QR = "qb AS (SELECT *, floor((row_number() OVER (PARTITION BY t ORDER BY value, symbol) - 1) * 5.0 / count(*) OVER (PARTITION BY t))::BIGINT + 1 AS quantile FROM al), qr AS (SELECT t, quantile, count(*) AS sample_count, avg(r) AS m FROM qb GROUP BY 1, 2)"


@query(f"WITH {SCORES}, {LABELS}, {QR} SELECT t, quantile, sample_count, round(m, 6) AS mean_forward_return FROM qr")
def d3_quantile_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.quantile_returns(scores(spark, sf), labels(spark, sf)), "mean_forward_return")


@query(f"WITH {SCORES}, {LABELS}, {QR} SELECT t, quantile, sample_count, round(m, 6) AS mean_forward_return FROM qr")
def d3_quantile_returns_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.quantile_returns(scores(spark, sf), labels(spark, sf), split=True), "mean_forward_return")


COVER = "cov AS (SELECT f.t, count(*) AS eligible_count, count(*) AS factor_count, count(f.value) AS valid_factor_count, count(*) AS label_count, sum(CASE WHEN l.why IS NULL THEN 1 ELSE 0 END) AS valid_label_count, sum(CASE WHEN l.why IS NULL AND f.value IS NOT NULL THEN 1 ELSE 0 END) AS aligned_valid_count FROM fac f JOIN lab l ON f.symbol = l.symbol AND f.t = l.t GROUP BY f.t)"


@query(f"WITH {SCORES}, {LABELS}, {COVER} SELECT t, eligible_count, factor_count, valid_factor_count, label_count, valid_label_count::BIGINT AS valid_label_count, aligned_valid_count::BIGINT AS aligned_valid_count FROM cov")
def d4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.coverage(scores(spark, sf), labels(spark, sf), everyone(panel.bars(spark, sf, "1d"))))


TURN = f"tr AS (SELECT symbol, t, CASE WHEN n = 1 THEN 0.5 ELSE ({AVG_RANK} - 1) / (n - 1) END AS rk FROM sc), td AS (SELECT t, abs(rk - lag(rk) OVER (PARTITION BY symbol ORDER BY t)) AS d FROM tr), tv AS (SELECT t, count(d) AS sample_count, avg(d) AS rank_turnover FROM td GROUP BY t)"


@query(f"WITH {SCORES}, {TURN} SELECT t, sample_count, round(rank_turnover, 6) AS rank_turnover FROM tv")
def d5_rank_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.rank_turnover(scores(spark, sf)), "rank_turnover")


@query(f"WITH {SCORES}, {LABELS}, {IC}, {QR}, {COVER}, {TURN} SELECT ic.t, round(rank_ic, 6) AS rank_ic, aligned_valid_count::BIGINT AS aligned_valid_count, round(rank_turnover, 6) AS rank_turnover, round((SELECT m FROM qr WHERE qr.t = ic.t AND quantile = 5), 6) AS top_return FROM ic JOIN cov ON ic.t = cov.t JOIN tv ON ic.t = tv.t")
def d6_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    e = research.evaluate(scores(spark, sf), labels(spark, sf), everyone(panel.bars(spark, sf, "1d")))
    top = e["quantiles"].where("quantile = 5").select("timestamp", F.col("mean_forward_return").alias("top_return"))
    out = e["ic"].select("timestamp", "rank_ic").join(e["coverage"].select("timestamp", "aligned_valid_count"), "timestamp").join(e["turnover"].select("timestamp", "rank_turnover"), "timestamp").join(top, "timestamp", "left")
    return rounded(out, "rank_ic", "rank_turnover", "top_return")


@query(f"WITH {SCORES}, {LABELS}, {IC}, {QR}, sp AS (SELECT avg(s) AS mean_spread FROM (SELECT max(CASE WHEN quantile = 5 THEN m END) - max(CASE WHEN quantile = 1 THEN m END) AS s FROM qr GROUP BY t)) SELECT count(*) AS observations, round(avg(rank_ic), 6) AS mean_rank_ic, round(avg(rank_ic) / stddev_pop(rank_ic), 6) AS rank_ic_ir, round(avg(CASE WHEN rank_ic > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(avg(sample_count), 6) AS mean_sample, round(max(mean_spread), 6) AS mean_spread FROM ic, sp WHERE rank_ic IS NOT NULL")
def d7_predictive_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, lab = scores(spark, sf), labels(spark, sf)
    out = research.predictive_summary(research.information_coefficient(s, lab), research.quantile_returns(s, lab))
    return rounded(out, "mean_rank_ic", "rank_ic_ir", "positive_share", "mean_sample", "mean_spread", time=False)


@query(f"WITH {SCORES}, {LABELS}, {COVER}, {TURN} SELECT sum(valid_factor_count)::BIGINT AS valid_rows, sum(eligible_count)::BIGINT AS eligible_rows, round(sum(valid_factor_count) / sum(eligible_count)::DOUBLE, 6) AS factor_coverage, round((SELECT avg(rank_turnover) FROM tv), 6) AS mean_rank_turnover FROM cov")
def d8_coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, lab = scores(spark, sf), labels(spark, sf)
    return rounded(research.coverage_summary(research.coverage(s, lab, everyone(panel.bars(spark, sf, "1d"))), research.rank_turnover(s)), "factor_coverage", "mean_rank_turnover", time=False)


PERIODS = [("first", START, START + 10 * D), ("second", START + 10 * D, START + 20 * D), ("third", START + 20 * D, END)]
PERIOD = "CASE " + " ".join(f"WHEN t >= {a} AND t + {2 * D} <= {b} THEN '{n}'" for n, a, b in PERIODS) + " END"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return research.tagged(research.information_coefficient(scores(spark, sf), labels(spark, sf)), PERIODS, 2 * D)


@query(f"WITH {SCORES}, {LABELS}, {IC} SELECT t, {PERIOD} AS period, round(rank_ic, 6) AS rank_ic FROM ic WHERE {PERIOD} IS NOT NULL")
def d9_segment_tags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tagged(spark, sf), "rank_ic").select("t", "period", "rank_ic")


@query(f"WITH {SCORES}, {LABELS}, {IC}, tg AS (SELECT {PERIOD} AS period, rank_ic FROM ic WHERE {PERIOD} IS NOT NULL) SELECT coalesce(period, 'ALL') AS period, count(rank_ic) AS observations, round(avg(rank_ic), 6) AS mean_rank_ic, round(stddev_pop(rank_ic), 6) AS std_rank_ic FROM tg GROUP BY ROLLUP (period)")
def d10_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.by_period(tagged(spark, sf)), "mean_rank_ic", "std_rank_ic", time=False)


@query(f"WITH {SCORES}, {LABELS}, {IC}, tg AS (SELECT rank_ic FROM ic WHERE {PERIOD} IS NOT NULL) SELECT count(rank_ic) AS observations, round(avg(rank_ic), 6) AS pooled_mean, round(stddev_pop(rank_ic), 6) AS pooled_std FROM tg")
def d11_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.pooled(research.by_period(tagged(spark, sf)).where("period <> 'ALL'")), "pooled_mean", "pooled_std", time=False)


# --------------------------------------------------------------------------------------- universe

RULES = universe.Rules(exclude=("7", "11"), min_age_days=5, min_history_bars=3, volume_window="3d", min_quote_volume=20.0, missing_window="5d", max_missing_ratio=0.6)
CONTRACTS = f"""con AS (SELECT o_custkey::VARCHAR AS symbol, {START} + (epoch_ms(o_orderdate) // {D}) % 30 * {D} AS st, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS os, arg_max(c_mktsegment, o_orderkey) AS ms
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
snaps AS (SELECT symbol, st, CASE WHEN k % 17 = 0 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type, CASE WHEN os = 'P' THEN 'BREAK' ELSE 'TRADING' END AS status, CASE WHEN ms = 'MACHINERY' THEN 'BUSD' ELSE 'USDT' END AS quote_asset,
 CASE WHEN ms = 'FURNITURE' THEN 'COIN' ELSE 'USDT' END AS margin_asset, {START} - (k % 60) * {D} + 864000000 AS onboard, CASE WHEN k % 23 = 0 THEN {START + 15 * D} END AS delivery FROM con)"""
UNIVERSE = f"""{sql.bars("1d")}, {CONTRACTS},
syms AS (SELECT symbol FROM bars UNION SELECT symbol FROM snaps),
grid AS (SELECT symbol, g.t FROM syms, (SELECT unnest(generate_series({START + 7 * D}, {END - 1}, {5 * D})) AS t) g),
own AS (SELECT g.symbol, g.t, count(b.t) AS history, min(b.t) AS first_open, sum(CASE WHEN b.t + {D} > g.t - {3 * D} THEN b.quote_volume ELSE 0 END) AS vol, sum(CASE WHEN b.t + {D} > g.t - {5 * D} THEN 1 ELSE 0 END) AS have FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.t + {D} <= g.t GROUP BY 1, 2),
pan AS (SELECT o.*, s.* EXCLUDE (symbol), coalesce(s.onboard, o.first_open) AS listed FROM own o ASOF LEFT JOIN snaps s ON o.symbol = s.symbol AND o.t >= s.st),
uni AS (SELECT symbol, t, history, coalesce(vol, 0.0) AS vol, greatest(0.0, least(1.0, 1 - have / 5.0)) AS missing, status, (t - listed) // {D} AS age,
 CASE WHEN symbol IN ('7', '11') THEN 'EXPLICITLY_EXCLUDED' WHEN st IS NULL THEN 'NO_CONTRACT_SNAPSHOT' WHEN contract_type <> 'PERPETUAL' THEN 'NOT_PERPETUAL' WHEN quote_asset <> 'USDT' THEN 'WRONG_QUOTE_ASSET' WHEN margin_asset <> 'USDT' THEN 'WRONG_MARGIN_ASSET'
 WHEN listed IS NULL OR listed > t THEN 'NOT_LISTED' WHEN delivery <= t THEN 'DELISTED' WHEN status <> 'TRADING' THEN 'NOT_TRADING' WHEN (t - listed) // {D} < 5 THEN 'WARMUP' WHEN history < 3 THEN 'INSUFFICIENT_HISTORY' WHEN 1 - have / 5.0 > 0.6 THEN 'MISSING_DATA' WHEN coalesce(vol, 0) < 20 THEN 'ILLIQUID' ELSE 'ELIGIBLE' END AS reason FROM pan)"""


def universe_panel(spark: SparkSession, sf: str) -> DataFrame:
    return universe.build(panel.bars(spark, sf, "1d"), panel.contracts(spark, sf), START + 7 * D, END, "5d", "1d", RULES)


@query(f"WITH {UNIVERSE} SELECT symbol, t, reason = 'ELIGIBLE' AS is_eligible, reason AS reason_code, CASE WHEN age >= 0 THEN age END AS age, history AS history_bars, round(vol, 4) AS volume, round(missing, 6) AS missing_ratio, status AS contract_status FROM uni")
def u6_universe(spark: SparkSession, sf: str) -> DataFrame:
    u = rounded(universe_panel(spark, sf), "missing_ratio")
    return u.select("symbol", "t", "is_eligible", "reason_code", F.when(F.col("listing_age_days") >= 0, F.col("listing_age_days")).alias("age"), "history_bars", F.round("rolling_quote_volume", 4).alias("volume"), "missing_ratio", "contract_status")


@query(f"WITH {UNIVERSE} SELECT reason AS reason_code, count(*) AS n, count(DISTINCT symbol) AS symbols FROM uni GROUP BY 1")
def u5_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return universe_panel(spark, sf).groupBy("reason_code").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


@query(f"WITH {sql.bars('1h')} SELECT symbol, t + {sql.HOUR} AS t, sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER w AS history_bars, min(t) OVER w AS first_t, round(sum(CASE WHEN is_complete THEN quote_volume ELSE 0 END) OVER w, 4) AS cumulative_quote FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)")
def u1_running_history(spark: SparkSession, sf: str) -> DataFrame:
    h = universe.running_history(panel.bars(spark, sf, "1h"))
    return h.select("symbol", ms("close_time").alias("t"), "history_bars", ms("first_bar_open").alias("first_t"), F.round("cumulative_quote", 4).alias("cumulative_quote"))


@query(f"WITH {UNIVERSE}, firsts AS (SELECT symbol, min(t) AS f FROM bars GROUP BY 1) SELECT u.symbol, u.t, u.history + CASE WHEN f.symbol IS NOT NULL THEN 10 ELSE 0 END AS history_bars FROM uni u LEFT JOIN firsts f ON u.symbol = f.symbol")
def u7_history_offsets(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1d")
    offsets = bars.groupBy("symbol").agg(F.min("open_time").alias("prior_first_bar_open")).withColumn("history_bars_offset", F.lit(10).cast("long"))
    return rounded(universe.build(bars, panel.contracts(spark, sf), START + 7 * D, END, "5d", "1d", RULES, offsets=offsets)).select("symbol", "t", "history_bars")


@query(f"""WITH {sql.bars('1h')}, g AS (SELECT unnest(generate_series({START + 5 * D}, {END - D}, {D})) AS t), f AS (SELECT symbol, min(t) AS f FROM bars GROUP BY 1),
s AS (SELECT g.t, b.symbol, sum(trades) AS bars, sum(quote_volume) AS volume FROM g JOIN bars b ON b.t + {sql.HOUR} > g.t - {D} AND b.t + {sql.HOUR} <= g.t GROUP BY 1, 2),
r AS (SELECT s.*, row_number() OVER (PARTITION BY t ORDER BY volume DESC, symbol) AS place FROM s JOIN f USING (symbol) WHERE f <= t - {3 * D} AND bars >= 40)
SELECT symbol, t, bars::BIGINT AS bars, round(volume, 4) AS volume, place FROM r WHERE place <= 3""")
def u8_liquid_universe(spark: SparkSession, sf: str) -> DataFrame:
    b = panel.bars(spark, sf, "1h")
    hours = b.select("symbol", F.col("open_time").alias("hour"), F.col("close_time").alias("available_at"), F.col("trades").alias("minute_count"), "quote_volume")
    out = rounded(universe.liquid(hours, timeaxis.schedule(spark, START + 5 * D, END, "1d"), 3, 40, 3))
    return out.select("symbol", "t", "bars", F.round("volume", 4).alias("volume"), F.col("place").cast("long").alias("place"))
