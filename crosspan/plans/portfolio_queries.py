"""Registered queries of selection, valuation, metric, barrier and reconciliation operators, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import ms
from crosspan.functions.work import kept
from crosspan.operators import barriers, crosssection, metrics, portfolio, reconcile, valuation
from crosspan.plans import sql
from crosspan.plans.research_queries import SCORES, SNAP, rounded, scores
from crosspan.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, H6 = sql.DAY, sql.STEP["6h"]

def query(text: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add

def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return crosssection.rank_snapshots(scores(spark, sf), "momentum")

def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})

# ---------------------------------------------------------------------------------- selection

ASC = "asc_ AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value, symbol) AS r FROM sc)"
PICK = "SELECT symbol, t, CASE WHEN r <= s THEN 'SHORT' ELSE 'LONG' END AS side, round(value, 6) AS score FROM p WHERE n >= 2 AND l + s <= n AND (r <= s OR r > n - l)"

@query(f"WITH {SCORES}, {ASC}, p AS (SELECT *, 10 AS l, 10 AS s FROM asc_) {PICK}")
def p1_select_count(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.long_short(scores(spark, sf), 10, 10), "score").select("symbol", "t", "side", "score")

@query(f"WITH {SCORES}, {ASC}, p AS (SELECT *, greatest(1, floor(n * 0.2)) AS l, greatest(1, floor(n * 0.1)) AS s FROM asc_) {PICK}")
def p2_select_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.long_short(scores(spark, sf), 0.2, 0.1, True), "score").select("symbol", "t", "side", "score")

@query(f"WITH {SCORES}, {SNAP}, req AS (SELECT 'LONG' AS side, unnest([1, 2, 3, 5]) AS q UNION ALL SELECT 'SHORT', unnest(generate_series(100, 120))) SELECT symbol, t, side, rk AS requested_rank, 'SELECTED_CURRENT_RANK' AS reason_code FROM snap JOIN req ON rk = q UNION ALL SELECT NULL, t, side, q, 'RANK_OUT_OF_RANGE' FROM (SELECT DISTINCT t, n FROM snap) JOIN req ON q > n")
def p3_exact_ranks(spark: SparkSession, sf: str) -> DataFrame:
    audit = portfolio.exact_ranks(snapshots(spark, sf), [(1, 3), (5, 5)], [(100, 120)])[1]
    return longs(rounded(audit), "requested_rank").select("symbol", "t", "side", "requested_rank", "reason_code")

TIMES = "ti AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT t FROM snap))"

@query(f"""WITH {SCORES}, {SNAP}, {TIMES}, req AS (SELECT 'LONG' AS side, unnest([1, 2, 200]) AS q UNION ALL SELECT 'SHORT', 90),
w AS (SELECT a.t, b.t AS st, side, q FROM ti a LEFT JOIN ti b ON b.idx = a.idx - 2 CROSS JOIN req)
SELECT w.t, st AS source_t, s.symbol, side, q::BIGINT AS requested_rank, CASE WHEN st IS NULL THEN 'INSUFFICIENT_RANK_HISTORY' WHEN s.symbol IS NULL THEN 'RANK_OUT_OF_RANGE' WHEN c.symbol IS NULL THEN 'HISTORICAL_RANK_NOT_CURRENTLY_ELIGIBLE' ELSE 'SELECTED_HISTORICAL_RANK' END AS reason_code
FROM w LEFT JOIN snap s ON s.t = st AND s.rk = q LEFT JOIN snap c ON c.t = w.t AND c.symbol = s.symbol""")
def p4_lagged_ranks(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(portfolio.lagged_ranks(snapshots(spark, sf), 2, [1, 2, 200], [90]))
    return longs(out, "requested_rank").select("t", ms("rank_source_time").alias("source_t"), "symbol", "side", "requested_rank", "reason_code")

@query(f"""WITH {SCORES}, {SNAP}, {TIMES}, tens AS (SELECT s.symbol, s.t, ti.idx, (rk + 9) // 10 AS g FROM snap s JOIN ti USING (t)),
f AS (SELECT *, CASE WHEN idx - lag(idx) OVER w = 1 AND g <= lag(g) OVER w THEN 0 ELSE 1 END AS b FROM tens WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
i AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY idx) AS isl FROM f), j AS (SELECT *, first(g) OVER w AS f0, row_number() OVER w AS pos FROM i WINDOW w AS (PARTITION BY symbol, isl ORDER BY idx)),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY idx) AS k FROM j WHERE f0 >= 6 AND pos > 1 AND g = 2) SELECT symbol, t, g AS ordinal_rank FROM h WHERE k = 1""")
def p5_rank_descent(spark: SparkSession, sf: str) -> DataFrame:
    tens = snapshots(spark, sf).withColumn("ordinal_rank", F.floor((F.col("ordinal_rank") + 9) / 10))
    return rounded(portfolio.rank_descent(tens, 6, 2)).select("symbol", "t", F.col("ordinal_rank").cast("long"))

@query(f"""WITH {SCORES}, {SNAP}, {TIMES}, p AS (SELECT s.symbol, s.t, s.value, CASE WHEN idx - lag(idx) OVER w = 1 THEN lag(s.value) OVER w END AS pv FROM snap s JOIN ti USING (t) WINDOW w AS (PARTITION BY s.symbol ORDER BY idx))
SELECT symbol, t, round(value, 6) AS score, CASE WHEN pv <= 0.2 AND value > 0.2 THEN 'LONG' ELSE 'FLAT' END AS side FROM p WHERE (pv <= 0.2 AND value > 0.2) OR (pv >= -0.2 AND value < -0.2)""")
def p6_crossover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.crossovers(scores(spark, sf), 0.2, -0.2), "score").select("symbol", "t", "score", "side")

PICKED = f"{SCORES}, {ASC}, p AS (SELECT *, 10 AS l, 10 AS s FROM asc_), pk AS ({PICK})"

@query(f"WITH {PICKED} SELECT symbol, t, side, round(CASE WHEN side = 'LONG' THEN 0.7 ELSE -0.5 END * CASE WHEN sum(abs(score)) OVER w > 0 THEN abs(score) / sum(abs(score)) OVER w ELSE 1.0 / count(*) OVER w END, 5) AS weight FROM pk WINDOW w AS (PARTITION BY t, side)")
def p7_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = portfolio.weights(rounded(portfolio.long_short(scores(spark, sf), 10, 10), "score", time=False), "score", 1.2, 0.2)
    return rounded(out).select("symbol", "t", "side", F.round("unconstrained_weight", 5).alias("weight"))

@query(f"WITH {PICKED}, w AS (SELECT symbol, t, CASE WHEN side = 'LONG' THEN 0.5 ELSE -0.5 END * abs(score) / sum(abs(score)) OVER (PARTITION BY t, side) AS w FROM pk) SELECT symbol, t, round(greatest(-0.08, least(0.08, w)), 5) AS weight, CASE WHEN abs(w) > 0.08 THEN 'MAX_SYMBOL_WEIGHT' ELSE '' END AS flag FROM w")
def p8_weight_cap(spark: SparkSession, sf: str) -> DataFrame:
    w = portfolio.weights(rounded(portfolio.long_short(scores(spark, sf), 10, 10), "score", time=False), "score")
    return rounded(portfolio.capped(w, 0.08)).select("symbol", "t", F.round("target_weight", 5).alias("weight"), F.col("constraint_flags").alias("flag"))

@query(f"""WITH {SCORES}, s AS (SELECT symbol, t, 1 / greatest(abs(value), 0.001) AS s FROM sc), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, symbol) - 1 AS i FROM s),
r AS (SELECT a.symbol, a.t, a.s, a.i, sum(b.s) AS rest FROM o a JOIN o b ON a.t = b.t AND b.i >= a.i GROUP BY ALL), f AS (SELECT t, min(i) AS m FROM r WHERE greatest(0, 0.5 - 0.05 * i) * s / rest <= 0.05 GROUP BY t)
SELECT r.symbol, r.t, round(CASE WHEN m IS NULL OR r.i < m THEN 0.05 ELSE greatest(0, 0.5 - 0.05 * m) * r.s / (SELECT x.rest FROM r x WHERE x.t = r.t AND x.i = m) END, 6) AS weight FROM r LEFT JOIN f ON r.t = f.t""")
def p9_water_filling(spark: SparkSession, sf: str) -> DataFrame:
    side = scores(spark, sf).where("is_valid").withColumn("volatility", F.abs("value"))
    return rounded(portfolio.water_filling(side), "weight").select("symbol", "t", "weight")

@query(f"""WITH RECURSIVE {SCORES}, {SNAP}, {TIMES}, li AS (SELECT t, idx, list(symbol ORDER BY rk) FILTER (WHERE rk <= 20) AS near, list(symbol ORDER BY rk) FILTER (WHERE rk <= 10) AS top FROM snap JOIN ti USING (t) GROUP BY 1, 2),
hy AS (SELECT t, idx, top AS chosen, []::VARCHAR[] AS kept FROM li WHERE idx = 1
 UNION ALL SELECT t, idx, k || list_filter(top, lambda s: NOT list_contains(k, s))[1:10 - len(k)], k FROM (SELECT li.*, list_filter(li.near, lambda s: list_contains(hy.chosen, s))[1:10] AS k FROM hy JOIN li ON li.idx = hy.idx + 1)),
ch AS (SELECT t, kept, unnest(chosen) AS symbol FROM hy)
SELECT strategy, symbol, ch.t, rk::INT AS ordinal_rank, list_contains(kept, symbol) AS kept FROM ch JOIN snap USING (symbol, t), (SELECT unnest(['a', 'b']) AS strategy)""")
def p10_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    ranked = snapshots(spark, sf).withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return rounded(portfolio.hysteresis(ranked, 10, 20, every="5d")).select("strategy", "symbol", "t", "ordinal_rank", "kept")

VAL_BARS = f"""bars AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {H6} AS t, first(v ORDER BY ts, event_id) AS open, last(v ORDER BY ts, event_id) AS close, max(v) AS high, min(v) AS low FROM (SELECT *, 100 + value / 10 AS v FROM events) WHERE ts IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)"""
TARGETS = f"""{VAL_BARS}, reb AS (SELECT DISTINCT t FROM bars WHERE t % {2 * D} = 0 AND t > (SELECT min(t) FROM bars)),
rk AS (SELECT reb.t, b.symbol, row_number() OVER (PARTITION BY reb.t ORDER BY b.close DESC, b.symbol) AS r, count(*) OVER (PARTITION BY reb.t) AS n FROM reb JOIN bars b ON b.t = reb.t - {H6}),
tg AS (SELECT 'top' || c AS candidate, t, symbol, CASE WHEN r <= c THEN 0.5 / c ELSE -0.5 / c END AS w FROM rk JOIN bars ob USING (symbol, t), (SELECT unnest([1, 2]) AS c) WHERE r <= c OR r > n - c)"""

def val_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars whose prices move moderately: 100 + value / 10."""
    events = panel.table(spark, sf, "events").withColumn("value", 100 + F.col("value") / 10)
    return panel.bars_of(events, F.col("event_type"), "6h")

def val_targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two candidates: each second day the first and last one or two names by the last close."""
    from pyspark.sql import Window

    bars = val_bars(spark, sf)
    first = bars.agg(F.min("open_time").alias("_first"))
    rebalances = bars.select(F.col("open_time").alias("fill_time")).distinct().crossJoin(first).where((ms("fill_time") % (2 * D) == 0) & (F.col("fill_time") > F.col("_first"))).select("fill_time")
    w = Window.partitionBy("fill_time")
    ranked = rebalances.join(bars.select(F.col("close_time").alias("fill_time"), "symbol", "close", F.col("open_time").alias("signal_time")), "fill_time").withColumns({"r": F.row_number().over(w.orderBy(F.desc("close"), "symbol")), "n": F.count("*").over(w)})
    ranked = ranked.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).where("r <= c or r > n - c")
    targets = ranked.select(F.concat(F.lit("top"), "c").alias("candidate"), "fill_time", "signal_time", "symbol", F.when(F.col("r") <= F.col("c"), 0.5 / F.col("c")).otherwise(-0.5 / F.col("c")).alias("target_weight"))
    # A name without a bar to trade at drops out.
    targets = targets.join(bars.select(F.col("open_time").alias("fill_time"), "symbol"), ["fill_time", "symbol"], "left_semi")
    names = spark.createDataFrame([("top1",), ("top2",)], "candidate string")
    return targets, rebalances.join(names)

@query(f"WITH {TARGETS}, t2 AS (SELECT * FROM tg WHERE candidate = 'top2'), u AS (SELECT symbol, t FROM t2 UNION ALL SELECT symbol, t FROM t2 WHERE t % {4 * D} = 0 AND w > 0) SELECT (SELECT count(*) FROM t2 WHERE t % {4 * D} = 0 AND w > 0) AS duplicate_keys, count(*) FILTER (WHERE symbol < 'd') AS fill_not_after_signal, count(*) FILTER (WHERE symbol > 's') AS non_finite_weights, count(*) FILTER (WHERE t % {4 * D} <> 0) AS undeclared_times FROM u")
def p11_schedule_faults(spark: SparkSession, sf: str) -> DataFrame:
    """A schedule with rows twice, signals at their fill, weights that are no numbers and undeclared times."""
    targets, rebalances = val_targets(spark, sf)
    own = targets.where("candidate = 'top2'")
    bad = own.unionByName(own.where((ms("fill_time") % (4 * D) == 0) & (F.col("target_weight") > 0)))
    bad = bad.withColumns({"signal_time": F.when(F.col("symbol") < "d", F.col("fill_time")).otherwise(F.col("signal_time")), "target_weight": F.when(F.col("symbol") > "s", float("nan")).otherwise(F.col("target_weight"))})
    return portfolio.schedule_faults(bad, rebalances.where(ms("fill_time") % (4 * D) == 0))

@query(f"WITH {sql.bars('1d')}, fu AS (SELECT user_id::VARCHAR AS symbol, (epoch_us(ts) // 1000) // {5 * D} AS e FROM events WHERE value IS NOT NULL), n AS (SELECT count(DISTINCT e) AS n FROM fu), h AS (SELECT symbol, count(DISTINCT e) AS k FROM fu GROUP BY 1) SELECT s.symbol, coalesce(k, 0) AS events, coalesce(k, 0) < n.n AS zeroed FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN h ON s.symbol = h.symbol, n")
def p12_symbols_to_zero(spark: SparkSession, sf: str) -> DataFrame:
    funding = panel.funding(spark, sf, True).withColumn("funding_time", F.floor(ms("funding_time") / (5 * D)))
    return portfolio.symbols_to_zero(panel.bars(spark, sf, "1d"), funding)

@query(f"WITH {PICKED} SELECT k.symbol, k.t, round(sg * 1000::DOUBLE, 4) AS notional, round(floor(1000 / b.close / 0.01 + 1e-10) * 0.01 * sg, 6) AS quantity FROM (SELECT *, CASE WHEN side = 'SHORT' THEN -1 ELSE 1 END AS sg FROM pk) k JOIN bars b ON b.symbol = k.symbol AND b.t = k.t - {D}")
def p13_static_sizing(spark: SparkSession, sf: str) -> DataFrame:
    prices = panel.bars(spark, sf, "1d").select(F.col("close_time").alias("timestamp"), "symbol", F.col("close").alias("price"))
    out = portfolio.sized(portfolio.long_short(scores(spark, sf), 10, 10).join(prices, ["timestamp", "symbol"]), "margin", 250.0, 4.0, 0.01)
    return rounded(out, "quantity").select("symbol", "t", F.round("notional", 4).alias("notional"), "quantity")

# ---------------------------------------------------------------------------------- valuation

PAID = valuation.Costs(fee_bps=4.0, slippage_bps=2.0)
INITIAL = 1e6
SETTLED = f"fr AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) - 1 - ((epoch_us(ts) // 1000) - 1) % {H6} AS t, sum((value % 1 - 0.5) / 100) AS rate FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
# ``st``: every name of a candidate at every boundary, one boundary after another: the weight before
# (d) and after (w) trading, equity before costs (e), turnover, funding, and the average entry (en).
def folded_sql(targets: str, settled: str, step: int) -> str:
    return f"""RECURSIVE {targets}, {settled},
bt AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx, lead(t) OVER (ORDER BY t) AS nt FROM (SELECT t FROM reb UNION SELECT min(t) FROM bars UNION SELECT t FROM fr)),
nm AS (SELECT DISTINCT candidate, symbol FROM tg),
ca AS (SELECT nm.candidate, nm.symbol, bt.t, bt.idx, c.close FROM nm CROSS JOIN bt ASOF LEFT JOIN (SELECT symbol, t + {step} AS ct, close FROM bars) c ON c.symbol = nm.symbol AND bt.t >= c.ct),
gr AS (SELECT ca.candidate, ca.symbol, ca.t, ca.idx, o.open, coalesce(o.open, ca.close) AS mark, tg.w AS target, reb.t IS NOT NULL AS isreb, coalesce(fr.rate, 0) AS rate
 FROM ca LEFT JOIN bars o ON o.symbol = ca.symbol AND o.t = ca.t LEFT JOIN tg ON tg.candidate = ca.candidate AND tg.symbol = ca.symbol AND tg.t = ca.t LEFT JOIN reb ON reb.t = ca.t LEFT JOIN fr ON fr.symbol = ca.symbol AND fr.t = ca.t),
st AS (SELECT candidate, symbol, t, idx, mark, 0.0::DOUBLE AS d, 0.0::DOUBLE AS w, {INITIAL}::DOUBLE AS e, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS funding, NULL::DOUBLE AS en FROM gr WHERE idx = 0
 UNION ALL
 SELECT candidate, symbol, t, idx, mark, d, w, e, sum(abs(w - d)) OVER (PARTITION BY candidate), -sum(w * rate) OVER (PARTITION BY candidate),
  CASE WHEN abs(w) < 1e-15 THEN NULL WHEN d * w <= 0 THEN mark WHEN abs(w) > abs(d) + 1e-15 THEN (pen * abs(d) + mark * abs(w - d)) / abs(w) ELSE pen END
 FROM (SELECT *, CASE WHEN isreb AND open IS NOT NULL THEN coalesce(target, 0) ELSE d END AS w FROM (SELECT *, pw * rr / g AS d, pe * g AS e FROM (
  SELECT n.*, p.w AS pw, p.e AS pe, p.en AS pen, coalesce(n.mark / p.mark, 1) AS rr, 1 - {PAID.rate!r} * p.turnover + p.funding + sum(p.w * (coalesce(n.mark / p.mark, 1) - 1)) OVER (PARTITION BY n.candidate) AS g
  FROM st p JOIN gr n ON n.candidate = p.candidate AND n.symbol = p.symbol AND n.idx = p.idx + 1))))"""

def valued_sql(folded: str) -> str:
    return f"""{folded}, ck AS (SELECT DISTINCT t AS bt FROM bars),
po AS (SELECT st.candidate, st.symbol, ck.bt AS t, bt.t AS k, st.e, st.turnover, st.funding, st.w, st.w * st.e / st.mark AS q, st.mark, m.close AS price
 FROM st JOIN bt USING (idx) JOIN ck ON ck.bt >= bt.t AND (bt.nt IS NULL OR ck.bt < bt.nt) ASOF LEFT JOIN bars m ON m.symbol = st.symbol AND ck.bt >= m.t),
eq AS (SELECT candidate, t, k, any_value(e) AS e, any_value(turnover) AS tu, any_value(funding) AS fu, any_value(e) * (1 - {PAID.rate!r} * any_value(turnover) + any_value(funding)) + coalesce(sum(w * e * (price / mark - 1)), 0) AS equity,
 coalesce(sum(abs(q * price)), 0) AS gross, coalesce(sum(q * price), 0) AS net FROM po GROUP BY candidate, t, k),
ru AS (SELECT *, coalesce(lag(equity) OVER w, {INITIAL}) AS prev, equity / greatest(max(equity) OVER w, {INITIAL}) - 1 AS dd, gross / equity AS gx, net / equity AS nx FROM eq WINDOW w AS (PARTITION BY candidate ORDER BY t)),
rt AS (SELECT candidate, t, equity, dd, gx, nx, equity / prev - 1 AS r, CASE WHEN t = k THEN e * tu * {PAID.fee_bps} / 1e4 / prev ELSE 0 END AS fee, CASE WHEN t = k THEN e * tu * {PAID.slippage_bps} / 1e4 / prev ELSE 0 END AS slip,
 CASE WHEN t = k THEN e * fu / prev ELSE 0 END AS fund, CASE WHEN t = k THEN e * tu / prev ELSE 0 END AS turn FROM ru),
rg AS (SELECT *, r + fee + slip - fund AS gp FROM rt)"""

FOLDED = folded_sql(TARGETS, SETTLED, H6)
VALUED = valued_sql(FOLDED)
RETURN_COLUMNS = "round(gp, 7) AS gross_price_return, round(fee, 8) AS fee_cost, round(slip, 8) AS slippage_cost, round(fund, 7) AS funding_return, round(r, 7) AS net_return, round(equity, 2) AS equity, round(dd, 6) AS drawdown, round(gx, 6) AS gross_exposure, round(nx, 6) AS net_exposure, round(turn, 6) AS turnover"

def market(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, targets and rebalances, each worked out once: the valuation reads them several times."""
    bars, (targets, rebalances) = kept(val_bars(spark, sf), "bars"), val_targets(spark, sf)
    return bars, kept(targets, "targets"), rebalances

def valued(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Returns and positions with fees, slippage and funding."""
    return valuation.value(*market(spark, sf), "6h", PAID, INITIAL, panel.funding(spark, sf))

def paid_returns(spark: SparkSession, sf: str) -> DataFrame:
    return valued(spark, sf)[0]

DIGITS = {"gross_price_return": 7, "fee_cost": 8, "slippage_cost": 8, "funding_return": 7, "net_return": 7, "equity": 2, "drawdown": 6, "gross_exposure": 6, "net_exposure": 6, "turnover": 6}

@query(f"WITH {VALUED} SELECT candidate, t, {RETURN_COLUMNS} FROM rg")
def v6_valuation(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(paid_returns(spark, sf))
    return out.select("candidate", "t", *(F.round(c, n).alias(c) for c, n in DIGITS.items()))

@query(f"WITH {VALUED} SELECT candidate, t, symbol, round(w, 7) AS weight, round(q, 3) AS quantity, round(q * price, 2) AS notional, round(w * e * (price / mark - 1), 2) AS unrealized FROM po WHERE abs(w) >= 1e-15")
def v10_positions(spark: SparkSession, sf: str) -> DataFrame:
    p = valued(spark, sf)[1]
    return p.select("candidate", ms("open_time").alias("t"), "symbol", F.round("weight", 7).alias("weight"), F.round("quantity", 3).alias("quantity"), F.round("notional", 2).alias("notional"), F.round("unrealized", 2).alias("unrealized"))

def boundary_states(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.states(*market(spark, sf), "6h", PAID, INITIAL, panel.funding(spark, sf))[2]

@query(f"""WITH {FOLDED}, hs AS (SELECT * FROM st WHERE abs(w) >= 1e-15 OR w <> d),
al AS (SELECT candidate, idx, symbol, w, e, mark, turnover, funding, w - d AS traded FROM hs
 UNION ALL SELECT candidate, idx, NULL, 0, any_value(e), NULL, any_value(turnover), any_value(funding), 0 FROM st WHERE (candidate, idx) NOT IN (SELECT (candidate, idx) FROM hs) GROUP BY 1, 2)
SELECT candidate, idx, symbol, round(w, 7) AS weight, round(coalesce(w * e / mark, 0), 3) AS quantity, round(mark, 6) AS mark, round(e, 2) AS equity, round(turnover, 6) AS turnover, round(funding, 7) AS funding, round(traded, 7) AS traded FROM al""")
def v2_boundary_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = boundary_states(spark, sf)
    digits = {"weight": 7, "quantity": 3, "mark": 6, "equity": 2, "turnover": 6, "funding": 7, "traded": 7}
    return out.select("candidate", "idx", "symbol", *(F.round(c, n).alias(c) for c, n in digits.items()))

@query(f"WITH {TARGETS}, b AS (SELECT t FROM reb UNION SELECT min(t) FROM bars UNION SELECT (epoch_us(ts) // 1000) - 1 - ((epoch_us(ts) // 1000) - 1) % {H6} FROM events WHERE value IS NOT NULL) SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM b")
def v1_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    cuts = valuation.boundaries(val_bars(spark, sf), val_targets(spark, sf)[1], panel.funding(spark, sf), "6h")
    return cuts.select(ms("open_time").alias("t"), F.col("idx").cast("long").alias("idx"))

@query(f"WITH {VALUED} SELECT candidate, t, round(gp, 7) AS gross_price_return, round(fee + slip, 8) AS trade_costs, round(fund, 7) AS funding_return, round(dd, 6) AS drawdown FROM rg WHERE fee <> 0 OR fund <> 0")
def v5_bar_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(paid_returns(spark, sf).where("fee_cost <> 0 or funding_return <> 0"))
    return out.select("candidate", "t", F.round("gross_price_return", 7).alias("gross_price_return"), F.round(F.col("fee_cost") + F.col("slippage_cost"), 8).alias("trade_costs"), F.round("funding_return", 7).alias("funding_return"), F.round("drawdown", 6).alias("drawdown"))

@query(f"WITH {VAL_BARS}, fu AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) - 1 - ((epoch_us(ts) // 1000) - 1) % {H6} AS t, (value % 1 - 0.5) / 100 AS rate, value AS mark, event_id FROM events WHERE value IS NOT NULL) SELECT f.event_id, f.symbol, round(-10 * mark * rate, 6) AS cash FROM fu f JOIN bars b ON b.symbol = f.symbol AND b.t = f.t")
def v3_funding_cash(spark: SparkSession, sf: str) -> DataFrame:
    holdings = val_bars(spark, sf).select("symbol", "open_time", "open", F.lit(10.0).alias("quantity"))
    return rounded(valuation.funding_cash(panel.funding(spark, sf), holdings, "6h"), "cash", time=False).select("event_id", "symbol", "cash")

# Six candidates, 64 names and 360 bars of two hours; each holds eight names and changes them every 30 bars.
H2 = 7_200_000
SIX_BARS = f"bars AS (SELECT (user_id % 64)::VARCHAR AS symbol, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {H2} AS t, first(v ORDER BY ts, event_id) AS open, last(v ORDER BY ts, event_id) AS close FROM (SELECT *, 100 + value / 10 AS v FROM events) WHERE ts IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)"
SIX_TARGETS = f"""{SIX_BARS}, reb AS (SELECT DISTINCT t FROM bars WHERE t % {30 * H2} = 0 AND t > (SELECT min(t) FROM bars)),
rk AS (SELECT reb.t, b.symbol, row_number() OVER (PARTITION BY reb.t ORDER BY b.close DESC, b.symbol) AS r, count(*) OVER (PARTITION BY reb.t) AS n FROM reb JOIN bars b ON b.t = reb.t - {H2} JOIN bars ob ON ob.symbol = b.symbol AND ob.t = reb.t),
tg AS (SELECT 'offset' || c AS candidate, t, symbol, CASE WHEN r BETWEEN c + 1 AND c + 4 THEN 0.125 ELSE -0.125 END AS w FROM rk, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c) WHERE r BETWEEN c + 1 AND least(c + 4, n // 2) OR r BETWEEN greatest(n - c - 3, n // 2 + 1) AND n - c)"""
UNSETTLED = "fr AS (SELECT NULL::VARCHAR AS symbol, NULL::BIGINT AS t, NULL::DOUBLE AS rate WHERE false)"

@query(f"WITH {valued_sql(folded_sql(SIX_TARGETS, UNSETTLED, H2))} SELECT candidate, t, {RETURN_COLUMNS} FROM rg")
def v14_six_candidates(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    events = panel.table(spark, sf, "events").withColumn("value", 100 + F.col("value") / 10)
    bars = kept(panel.bars_of(events, (F.col("user_id") % 64).cast("string"), "2h"), "bars")
    first = bars.agg(F.min("open_time").alias("_first"))
    rebalances = bars.select(F.col("open_time").alias("fill_time")).distinct().crossJoin(first).where((ms("fill_time") % (30 * H2) == 0) & (F.col("fill_time") > F.col("_first"))).select("fill_time")
    last = bars.select(F.col("close_time").alias("fill_time"), "symbol", "close")
    w, r, n, c = Window.partitionBy("fill_time"), F.col("r"), F.col("n"), F.col("c")
    ranked = rebalances.join(last, "fill_time").join(bars.select(F.col("open_time").alias("fill_time"), "symbol"), ["fill_time", "symbol"]).withColumns({"r": F.row_number().over(w.orderBy(F.desc("close"), "symbol")), "n": F.count("*").over(w)})
    half = F.floor(n / 2)
    long, short = r.between(c + 1, F.least(c + 4, half)), r.between(F.greatest(n - c - 3, half + 1), n - c)
    targets = ranked.withColumn("c", F.explode(F.array(*map(F.lit, range(6))))).where(long | short).select(F.concat(F.lit("offset"), "c").alias("candidate"), "fill_time", "symbol", F.when(r.between(c + 1, c + 4), 0.125).otherwise(-0.125).alias("target_weight"))
    targets = kept(targets, "targets")
    names = targets.select("candidate").distinct()  # who never finds a name isn't valued
    out = rounded(valuation.value(bars, targets, rebalances.crossJoin(names), "2h", PAID, INITIAL)[0])
    return out.select("candidate", "t", *(F.round(x, d).alias(x) for x, d in DIGITS.items()))

DELTAS = f"{TARGETS}, dl AS (SELECT candidate, t, symbol, w * 1.0 AS d FROM tg)"

@query(f"WITH {DELTAS} SELECT candidate, t, symbol, round(d * least(1.0, 0.6 / sum(abs(d)) OVER (PARTITION BY candidate, t)), 6) AS delta FROM dl")
def v7_turnover_limit(spark: SparkSession, sf: str) -> DataFrame:
    d = val_targets(spark, sf)[0].select("candidate", F.col("fill_time").alias("timestamp"), "symbol", F.col("target_weight").alias("delta"))
    return rounded(valuation.limited(d, 0.6), "delta")

def val_trades(spark: SparkSession, sf: str) -> DataFrame:
    targets = val_targets(spark, sf)[0]
    opens = val_bars(spark, sf).select(F.col("open_time").alias("fill_time"), "symbol", F.col("open").alias("price"))
    trades = targets.join(opens, ["fill_time", "symbol"]).select("candidate", F.col("fill_time").alias("timestamp"), "symbol", (F.col("target_weight") * INITIAL).alias("delta_notional"), "price")
    return valuation.trade_costs(trades, PAID)

TRADES = f"{TARGETS}, trd AS (SELECT candidate, tg.t, tg.symbol, w * {INITIAL} AS dn, b.open AS price FROM tg JOIN bars b ON b.symbol = tg.symbol AND b.t = tg.t)"

@query(f"WITH {TRADES} SELECT candidate, t, symbol, round(abs(dn) * 4 / 1e4, 4) AS fee, round(abs(dn) * 2 / 1e4, 4) AS slippage, round(price * (1 + sign(dn) * 2 / 1e4), 6) AS fill_price FROM trd")
def v8_trade_costs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(val_trades(spark, sf), "fill_price").select("candidate", "t", "symbol", F.round("fee", 4).alias("fee"), F.round("slippage", 4).alias("slippage"), "fill_price")

@query(f"WITH {FOLDED} SELECT candidate, idx, symbol, round(w, 7) AS weight, round(en, 6) AS entry_price FROM st WHERE abs(w) >= 1e-15")
def v9_average_entry(spark: SparkSession, sf: str) -> DataFrame:
    out = boundary_states(spark, sf).where("symbol is not null and weight <> 0")
    return out.select("candidate", "idx", "symbol", F.round("weight", 7).alias("weight"), F.round("entry_price", 6).alias("entry_price"))

@query(f"WITH {TRADES}, fu AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) - 1 - ((epoch_us(ts) // 1000) - 1) % {H6} AS t, -10 * value * (value % 1 - 0.5) / 100 AS cash FROM events WHERE value IS NOT NULL), u AS (SELECT candidate, t, symbol, -abs(dn) * 4 / 1e4 AS fee, -abs(dn) * 2 / 1e4 AS slip, 0.0 AS cash FROM trd UNION ALL SELECT 'top1', f.t, f.symbol, 0, 0, cash FROM fu f JOIN bars b ON b.symbol = f.symbol AND b.t = f.t) SELECT candidate, t, symbol, round(sum(fee), 4) AS fee, round(sum(slip), 4) AS slippage, round(sum(cash), 4) AS funding FROM u GROUP BY 1, 2, 3")
def v11_cost_ledger(spark: SparkSession, sf: str) -> DataFrame:
    holdings = val_bars(spark, sf).select("symbol", "open_time", "open", F.lit(10.0).alias("quantity"))
    cash = valuation.funding_cash(panel.funding(spark, sf), holdings, "6h").select(F.lit("top1").alias("candidate"), F.col("open_time").alias("timestamp"), "symbol", "cash")
    out = rounded(valuation.cost_ledger(val_trades(spark, sf), cash))
    return out.withColumns({c: F.round(c, 4) for c in ("fee", "slippage", "funding")})

@query(f"WITH {VALUED} SELECT candidate, round(arg_max(equity, t), 2) AS ending_equity, round(arg_max(equity, t) / {INITIAL} - 1, 6) AS total_return, round(min(dd), 6) AS max_drawdown, count(*) FILTER (WHERE turn > 0) AS trading_bars FROM rg GROUP BY 1")
def v12_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(valuation.leaderboard(paid_returns(spark, sf), INITIAL), "total_return", "max_drawdown", time=False)
    return out.select("candidate", F.round("ending_equity", 2).alias("ending_equity"), "total_return", "max_drawdown", "trading_bars")

@query(f"WITH {VALUED} SELECT candidate, round(exp(sum(ln(1 + r))) - 1, 6) AS net_return, round(exp(sum(ln(1 + gp))) - 1, 6) AS gross_return, round(sum(fee), 7) AS fees, round(sum(slip), 7) AS slippage, round(sum(fund), 6) AS funding, round(sum(turn), 5) AS turnover, round(avg(gx), 6) AS mean_gross FROM rg GROUP BY 1")
def v13_matrix_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(valuation.matrix_summary(paid_returns(spark, sf)), "net_return", "gross_return", "mean_gross", "funding", time=False)
    return out.withColumns({"fees": F.round("fees", 7), "slippage": F.round("slippage", 7), "turnover": F.round("turnover", 5)})

# ------------------------------------------------------------------------------------ metrics

A = 365.25 * 86400 / 21600

@query(f"""WITH {VALUED}, s AS (SELECT candidate, count(*) AS n, arg_max(equity, t) / {INITIAL} - 1 AS tot, avg(r) AS m, stddev_pop(r) AS s, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) AS d, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM rg GROUP BY 1)
SELECT candidate, n AS observations, round(tot, 6) AS total_return, round(pow(1 + tot, {A} / n) - 1, 4) AS annualized_return, round(s * sqrt({A}), 6) AS volatility, round(m / s * sqrt({A}), 5) AS sharpe, round(m / d * sqrt({A}), 5) AS sortino, round(mdd, 6) AS max_drawdown, round((pow(1 + tot, {A} / n) - 1) / -mdd, 4) AS calmar, round(hit, 6) AS hit_rate FROM s""")
def m1_performance(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(metrics.performance(paid_returns(spark, sf), "6h"), "total_return", "volatility", "max_drawdown", "hit_rate", time=False)
    return out.withColumns({"annualized_return": F.round("annualized_return", 4), "sharpe": F.round("sharpe", 5), "sortino": F.round("sortino", 5), "calmar": F.round("calmar", 4)})

#: Ledgers with one fault each, made of top1's: a row twice, without a time, without a return, with a
#: return below -1, with equity below 0, and with equity that the returns don't make.
FAULTS = ("twice", "untimed", "unreal", "lost", "under", "drift")
LEDGERS = f"""{VALUED}, nu AS (SELECT candidate, t, r, equity, row_number() OVER (PARTITION BY candidate ORDER BY t) AS i FROM rg),
ld AS (SELECT candidate, t, r, equity, i, 0 AS copy FROM nu UNION ALL SELECT f, CASE WHEN f = 'untimed' AND i = 4 THEN NULL ELSE t END, CASE WHEN f = 'unreal' AND i = 5 THEN 'NaN'::DOUBLE WHEN f = 'lost' AND i = 6 THEN -1.5 ELSE r END,
 CASE WHEN f = 'under' AND i = 7 THEN -equity WHEN f = 'drift' AND i = 8 THEN equity * 1.001 ELSE equity END, i, 0 FROM nu, (SELECT unnest({list(FAULTS)}) AS f) WHERE candidate = 'top1' UNION ALL SELECT 'twice', t, r, equity, i, 1 FROM nu WHERE candidate = 'top1' AND i = 3),
lf AS (SELECT *, lag(t) OVER w = t AS same, coalesce(lag(equity) OVER w, equity / nullif(1 + r, 0)) * (1 + r) AS made FROM ld WINDOW w AS (PARTITION BY candidate ORDER BY t NULLS FIRST, copy))"""

def ledgers(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = paid_returns(spark, sf).select("candidate", "timestamp", "net_return", "equity").withColumn("i", F.row_number().over(Window.partitionBy("candidate").orderBy("timestamp")))
    top = rows.where("candidate = 'top1'")
    at = lambda f, i: (F.col("candidate") == f) & (F.col("i") == i)
    bad = top.withColumn("candidate", F.explode(F.array(*map(F.lit, FAULTS)))).withColumns({
        "timestamp": F.when(~at("untimed", 4), F.col("timestamp")), "net_return": F.when(at("unreal", 5), float("nan")).when(at("lost", 6), -1.5).otherwise(F.col("net_return")),
        "equity": F.when(at("under", 7), -F.col("equity")).when(at("drift", 8), F.col("equity") * 1.001).otherwise(F.col("equity")),
    })
    return rows.unionByName(bad).unionByName(top.where("i = 3").withColumn("candidate", F.lit("twice"))).drop("i")

@query(f"WITH {LEDGERS} SELECT candidate, coalesce(bool_or(same), false) AS duplicate_timestamp, bool_or(t IS NULL) AS null_timestamp, bool_or(NOT isfinite(r)) AS bad_return, bool_or(r <= -1) AS return_below_floor, bool_or(equity <= 0) AS nonpositive_equity, coalesce(bool_or(abs(made - equity) > 1e-10 * greatest(1, abs(made), abs(equity))), false) AS compound_mismatch FROM lf GROUP BY 1")
def m2_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.integrity(ledgers(spark, sf))

@query(f"WITH {VALUED} SELECT candidate, round(avg(gx), 6) AS mean_gross, round(max(gx), 6) AS max_gross, round(avg(abs(nx)), 6) AS mean_net, round(max(abs(nx)), 6) AS max_net, round(avg(turn), 6) AS mean_turnover, round(max(turn), 6) AS max_turnover, round(sum(turn), 5) AS total_turnover FROM rg GROUP BY 1")
def m3_risk(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(metrics.risk(paid_returns(spark, sf)), "mean_gross", "max_gross", "mean_net", "max_net", "mean_turnover", "max_turnover", time=False)
    return out.withColumn("total_turnover", F.round("total_turnover", 5))

@query(f"WITH {VALUED} SELECT candidate, round(sum(gp), 6) AS gross_price_return, round(sum(fee), 7) AS fee_cost, round(sum(slip), 7) AS slippage_cost, round(sum(fund), 6) AS funding_return, round(sum(r), 6) AS net_return, max(abs(gp - fee - slip + fund - r)) <= 1e-12 AS exact FROM rg GROUP BY 1")
def m4_attribution(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(metrics.attribution(paid_returns(spark, sf)), "gross_price_return", "funding_return", "net_return", time=False)
    return out.select("candidate", "gross_price_return", F.round("fee_cost", 7).alias("fee_cost"), F.round("slippage_cost", 7).alias("slippage_cost"), "funding_return", "net_return", (F.col("identity_error") <= 1e-12).alias("exact"))

@query(f"WITH {TRADES} SELECT candidate, count(*) AS trades, count(*) FILTER (WHERE dn > 0) AS buys, count(*) FILTER (WHERE dn < 0) AS sells, count(DISTINCT symbol) AS symbols, min(t) AS first_t, max(t) AS last_t, round(sum(abs(dn)), 2) AS notional FROM trd GROUP BY 1")
def m5_trade_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.trade_stats(val_trades(spark, sf))
    return out.select("candidate", "trades", "buys", "sells", "symbols", ms("first").alias("first_t"), ms("last").alias("last_t"), F.round("notional", 2).alias("notional"))

@query(f"WITH {VALUED}, i AS (SELECT candidate, t, dd, row_number() OVER (PARTITION BY candidate ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY candidate) AS n FROM rg), x AS (SELECT candidate, t FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY dd, t) AS k FROM i) WHERE k = 1) SELECT i.candidate, i.t FROM i LEFT JOIN x ON x.candidate = i.candidate AND x.t = i.t WHERE x.t IS NOT NULL OR i.i = 0 OR i.i = n - 1 OR floor(i.i * 9.0 / greatest(n - 1, 1)) <> floor((i.i - 1) * 9.0 / greatest(n - 1, 1))")
def m6_series_sample(spark: SparkSession, sf: str) -> DataFrame:
    r = paid_returns(spark, sf).withColumn("drawdown", F.col("drawdown"))
    return rounded(metrics.series_sample(r, 10)).select("candidate", "t")

@query(f"WITH {VALUED}, f AS (SELECT a.t, a.equity AS l, b.equity AS r FROM rg a JOIN rg b ON a.t = b.t WHERE a.candidate = 'top1' AND b.candidate = 'top2' AND abs(a.equity - b.equity) > 1e-9 ORDER BY a.t LIMIT 1) SELECT t, 'equity' AS field, round(l, 3) AS l, round(r, 3) AS r FROM f")
def m7_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    r = paid_returns(spark, sf)
    out = metrics.first_difference(r.where("candidate = 'top1'"), r.where("candidate = 'top2'"), ["equity"])
    return rounded(out).select("t", "field", F.round("left", 3).alias("l"), F.round("right", 3).alias("r"))

# ----------------------------------------------------------------------- barriers, reconciliation

BARRIERS = barriers.Barriers(stop=0.03, trailing=0.04, take=0.06, activation=0.01)
ENTRIES = f"""{VAL_BARS}, en AS (SELECT symbol || ':' || t AS entry_id, symbol, t AS et, CASE WHEN t // {D} % 2 = 0 THEN 1 ELSE -1 END AS sg, open AS p FROM bars WHERE t % {D} = 0),
pa AS (SELECT en.*, b.t, b.open, b.high, b.low, CASE WHEN sg = 1 THEN greatest(p, max(b.high) OVER w) ELSE least(p, min(b.low) OVER w) END AS best0, lead(b.open) OVER (PARTITION BY entry_id ORDER BY b.t) AS no FROM en JOIN bars b ON b.symbol = en.symbol AND b.t >= et AND b.t < et + 12 * {H6} WINDOW w AS (PARTITION BY entry_id ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pb AS (SELECT *, coalesce(best0, p) AS best, CASE WHEN sg = 1 THEN low ELSE high END AS bad, CASE WHEN sg = 1 THEN high ELSE low END AS good FROM pa),
hit AS (SELECT *, CASE WHEN sg * bad <= sg * p * (1 - sg * 0.03) THEN 'STOP_LOSS' WHEN sg * best >= sg * p * (1 + sg * 0.01) AND sg * bad <= sg * best * (1 - sg * 0.04) THEN 'TRAILING_STOP' WHEN sg * good >= sg * p * (1 + sg * 0.06) THEN 'TAKE_PROFIT' END AS reason FROM pb),
lv AS (SELECT *, CASE reason WHEN 'STOP_LOSS' THEN p * (1 - sg * 0.03) WHEN 'TRAILING_STOP' THEN best * (1 - sg * 0.04) ELSE p * (1 + sg * 0.06) END AS level, row_number() OVER (PARTITION BY entry_id ORDER BY t) AS k FROM hit WHERE reason IS NOT NULL)"""

def entries(spark: SparkSession, sf: str) -> DataFrame:
    b = val_bars(spark, sf).where(ms("open_time") % D == 0)
    return b.select(F.concat_ws(":", "symbol", ms("open_time")).alias("entry_id"), "symbol", F.col("open_time").alias("entry_time"), F.when(F.floor(ms("open_time") / D) % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.col("open").alias("entry_price"))

EXIT = "CASE WHEN reason = 'TAKE_PROFIT' THEN CASE WHEN en.sg = 1 THEN greatest(open, level) ELSE least(open, level) END ELSE CASE WHEN en.sg = 1 THEN least(open, level) ELSE greatest(open, level) END END"

@query(f"WITH {ENTRIES} SELECT en.entry_id, lv.t AS exit_t, coalesce(reason, 'NONE') AS reason, round(level, 6) AS level, round(CASE WHEN reason IS NOT NULL THEN {EXIT} END, 6) AS exit_price FROM en LEFT JOIN lv ON lv.entry_id = en.entry_id AND k = 1")
def b1_first_touch(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(barriers.first_touch(entries(spark, sf), val_bars(spark, sf), "6h", BARRIERS, 12), "level", "exit_price", time=False)
    return out.select("entry_id", ms("exit_bar").alias("exit_t"), "reason", "level", "exit_price")

@query(f"WITH {ENTRIES} SELECT en.entry_id, coalesce(reason, 'NONE') AS reason, round(no, 6) AS exit_price FROM en LEFT JOIN lv ON lv.entry_id = en.entry_id AND k = 1")
def b3_next_open_exit(spark: SparkSession, sf: str) -> DataFrame:
    out = barriers.first_touch(entries(spark, sf), val_bars(spark, sf), "6h", BARRIERS, 12, next_open=True)
    return rounded(out, "exit_price", time=False).select("entry_id", "reason", "exit_price")

@query(f"WITH {VALUED}, pk AS (SELECT *, greatest({INITIAL}, coalesce(max(equity) OVER (PARTITION BY candidate ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {INITIAL})) AS peak FROM rg), h AS (SELECT candidate, t, CASE WHEN equity <= {INITIAL} * 0.97 THEN 'PORTFOLIO_STOP_LOSS' WHEN equity <= peak * 0.98 THEN 'PORTFOLIO_MAX_DRAWDOWN' WHEN equity >= {INITIAL} * 1.05 THEN 'PORTFOLIO_TAKE_PROFIT' END AS reason FROM pk) SELECT candidate, min(t) AS t, arg_min(reason, t) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1")
def b4_portfolio_touch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(barriers.portfolio_touch(paid_returns(spark, sf), INITIAL, 0.03, 0.02, 0.05)).select("candidate", "t", "reason")

PRIORITY = {"1-URGENT": 0, "2-HIGH": 100, "3-MEDIUM": 200, "4-NOT SPECIFIED": 300, "5-LOW": 400}

def intents(spark: SparkSession, sf: str) -> DataFrame:
    o = panel.table(spark, sf, "orders")
    p = F.lit(None).cast("int")
    for name, value in PRIORITY.items():
        p = F.when(F.col("o_orderpriority") == name, value).otherwise(p)
    return o.select(F.col("o_orderkey").alias("instruction_id"), F.col("o_orderdate").cast("timestamp").alias("fill_time"), (F.col("o_custkey") % 20).cast("string").alias("symbol"), p.alias("priority"), F.col("o_totalprice").alias("requested_delta_notional"), F.lit("REQUESTED").alias("reason_code"))

def arbitrated(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.arbitrate(intents(spark, sf), spark.createDataFrame([("3",), ("5",)], "symbol string"))

INTENTS = """it AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS t, (o_custkey % 20)::VARCHAR AS symbol, (o_orderpriority[1:1]::INT - 1) * 100 AS priority, o_totalprice AS d FROM orders),
ib AS (SELECT *, symbol IN ('3', '5') AND priority = 400 AS cool FROM it), ic AS (SELECT *, first(CASE WHEN NOT cool THEN id END) OVER (PARTITION BY t, symbol ORDER BY cool, priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS win FROM ib),
ar AS (SELECT *, coalesce(win = id, false) AND NOT cool AS ok FROM ic)"""

@query(f"WITH {INTENTS} SELECT id AS instruction_id, symbol, win AS winner_instruction_id, CASE WHEN ok THEN 'ACCEPTED' ELSE 'SUPPRESSED' END AS outcome, CASE WHEN cool THEN 'COOLDOWN_ACTIVE' WHEN ok THEN 'REQUESTED' ELSE 'SUPPRESSED_BY_HIGHER_PRIORITY' END AS final_reason_code, CASE WHEN ok THEN d ELSE 0 END AS delta FROM ar")
def x1_arbitration(spark: SparkSession, sf: str) -> DataFrame:
    return arbitrated(spark, sf).select("instruction_id", "symbol", "winner_instruction_id", "outcome", "final_reason_code", F.col("constrained_delta_notional").alias("delta"))

def filled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    accepted = arbitrated(spark, sf).where("outcome = 'ACCEPTED'")
    k = F.col("instruction_id")
    once = accepted.where(k % 7 != 0).select("instruction_id", k.alias("trade_id"), "fill_time")
    twice = accepted.where((k % 13 == 0) & (k % 7 != 0)).select("instruction_id", (k + 10_000_000).alias("trade_id"), F.timestamp_millis(ms("fill_time") + D).alias("fill_time"))
    unknown = accepted.where(k % 11 == 0).select((k + 50_000_000).alias("instruction_id"), (k + 50_000_000).alias("trade_id"), "fill_time")
    return accepted, once.unionByName(twice).unionByName(unknown)

FILLS = f"{INTENTS}, ac AS (SELECT * FROM ar WHERE ok), fl AS (SELECT id, id AS tr, t FROM ac WHERE id % 7 <> 0 UNION ALL SELECT id, id + 10000000, t + {D} FROM ac WHERE id % 13 = 0 AND id % 7 <> 0 UNION ALL SELECT id + 50000000, id + 50000000, t FROM ac WHERE id % 11 = 0)"

@query(f"WITH {FILLS} SELECT f.id AS instruction_id, f.tr AS trade_id, CASE WHEN a.id IS NULL THEN 'UNKNOWN_INSTRUCTION' WHEN count(*) OVER (PARTITION BY f.id) > 1 THEN 'FILLED_TWICE' ELSE 'LINKED' END AS status FROM fl f LEFT JOIN ac a ON a.id = f.id UNION ALL SELECT id, NULL, 'NOT_FILLED' FROM ac WHERE d <> 0 AND id NOT IN (SELECT id FROM fl)")
def x2_link_fills(spark: SparkSession, sf: str) -> DataFrame:
    accepted, trades = filled(spark, sf)
    return reconcile.link_fills(trades, accepted)

@query(f"WITH {FILLS}, ev AS (SELECT id + 1 AS e FROM it WHERE id % 5 = 0), li AS (SELECT id + 1 AS e, id, ok FROM ar), ft AS (SELECT id, min(t) AS t, count(DISTINCT t) AS n FROM fl GROUP BY 1), j AS (SELECT ev.e, min(ft.t) AS t, count(DISTINCT ft.t) AS n, max(CASE WHEN NOT li.ok THEN 1 ELSE 0 END) AS s FROM ev LEFT JOIN li ON li.e = ev.e LEFT JOIN ft ON ft.id = li.id GROUP BY 1) SELECT e AS event_id, t AS fill_t, CASE WHEN n > 1 THEN 'SEVERAL_FILL_TIMES' WHEN n = 1 THEN 'FILLED' WHEN s = 1 THEN 'SUPPRESSED' ELSE 'END_OF_DATA' END AS status FROM j")
def x3_risk_events(spark: SparkSession, sf: str) -> DataFrame:
    events = intents(spark, sf).where("instruction_id % 5 = 0").select((F.col("instruction_id") + 1).alias("event_id"))
    instructions = arbitrated(spark, sf).withColumn("source_event_id", F.col("instruction_id") + 1)
    out = reconcile.link_risk_events(events, instructions, filled(spark, sf)[1])
    return out.select("event_id", ms("fill_time").alias("fill_t"), "status")

