"""Registered queries of the hourly scores, with their SQL. Windows are shortened to the tables' month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.operators import hourly_scores, timeaxis
from crosspan.plans import sql
from crosspan.plans.research_queries import END, START
from crosspan.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, H = sql.DAY, sql.HOUR


def query(text: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hours, funding, decisions)"""
    hours = panel.bars(spark, sf, "1h").select("symbol", F.col("close_time").alias("at"), "close")
    return hours, panel.funding(spark, sf), timeaxis.schedule(spark, START + D, END, "1d")


HOURS = f"""{sql.bars('1h')}, h AS (SELECT symbol, t + {H} AS t, close FROM bars WHERE close > 0),
hr AS (SELECT *, CASE WHEN t - lag(t) OVER w = {H} THEN ln(close / lag(close) OVER w) END AS r, ln(close / lag(close) OVER w) / sqrt((t - lag(t) OVER w) / {H}.0) AS g FROM h WINDOW w AS (PARTITION BY symbol ORDER BY t)),
dc AS (SELECT unnest(generate_series({START + D}, {END - 1}, {D})) AS t),
fu AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS f, ts, event_id, (value % 1 - 0.5) / 100 AS rate FROM events WHERE value IS NOT NULL)"""


@query(f"""WITH {HOURS}, v AS (SELECT dc.t, x.symbol, count(x.r) AS n, stddev_samp(x.r) AS s FROM dc JOIN hr x ON x.t > dc.t - {12 * H} AND x.t <= dc.t GROUP BY 1, 2)
SELECT v.symbol, v.t, round(ln(k.close / o.close) / (sqrt(72.0) * greatest(v.s, 0.002)), 6) AS score FROM v JOIN h a ON a.symbol = v.symbol AND a.t = v.t JOIN h k ON k.symbol = v.symbol AND k.t = v.t - {24 * H} JOIN h o ON o.symbol = v.symbol AND o.t = v.t - {96 * H} WHERE v.n = 12""")
def l1_buffered_momentum(spark: SparkSession, sf: str) -> DataFrame:
    hours, _, decisions = inputs(spark, sf)
    return hourly_scores.buffered_momentum(hours, decisions, 96, 24, 12).withColumn("score", F.round("score", 6))


def z(name: str) -> str:
    return f"{name}_c AS (SELECT *, median({name}) OVER (PARTITION BY t) AS m_{name} FROM {{src}}), {name}_z AS (SELECT *, CASE WHEN median(abs({name} - m_{name})) OVER (PARTITION BY t) = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, ({name} - m_{name}) / (1.4826 * median(abs({name} - m_{name})) OVER (PARTITION BY t)))) END AS z_{name} FROM {name}_c)"


@query(f"""WITH {HOURS}, v AS (SELECT dc.t, x.symbol, count(x.g) AS n, stddev_samp(x.g) AS s FROM dc JOIN hr x ON x.t > dc.t - {96 * H} AND x.t <= dc.t - {24 * H} GROUP BY 1, 2),
l3 AS (SELECT symbol, f, CASE WHEN count(rate) OVER w = 3 THEN -avg(rate) OVER w END AS carry FROM fu WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
j0 AS (SELECT v.symbol, v.t, ln(k.close / o.close) / v.s AS momentum, -ln(a.close / k.close) AS reversal FROM v JOIN h a ON a.symbol = v.symbol AND a.t = v.t JOIN h k ON k.symbol = v.symbol AND k.t = v.t - {24 * H} JOIN h o ON o.symbol = v.symbol AND o.t = v.t - {96 * H} WHERE n >= 40 AND s > 0),
j1 AS (SELECT j0.*, l3.carry FROM j0 ASOF JOIN l3 ON j0.symbol = l3.symbol AND j0.t >= l3.f), j AS (SELECT * FROM j1 WHERE carry IS NOT NULL),
{z('carry').format(src='j')}, {z('momentum').format(src='carry_z')}, {z('reversal').format(src='momentum_z')} SELECT symbol, t, round(0.40 * z_carry + 0.35 * z_momentum + 0.25 * z_reversal, 6) AS score FROM reversal_z""")
def l2_blend(spark: SparkSession, sf: str) -> DataFrame:
    hours, funding, decisions = inputs(spark, sf)
    return hourly_scores.blend(hours, funding, decisions, least=40).withColumn("score", F.round("score", 6))


LOOKED = f"lb AS (SELECT dc.t, x.symbol, x.r, (dc.t - x.t) // {H} AS lag FROM dc JOIN hr x ON x.t > dc.t - {{n}} * {H} AND x.t <= dc.t WHERE x.r IS NOT NULL)"


def rank_of(c: str) -> str:
    return f"((rank() OVER (PARTITION BY t ORDER BY {c}) + (count(*) OVER (PARTITION BY t, {c}) - 1) / 2.0) - 1) / (count(*) OVER (PARTITION BY t) - 1) - 0.5"


@query(f"""WITH {HOURS}, {LOOKED.format(n=72)}, m AS (SELECT *, median(r) OVER (PARTITION BY t, lag) AS m, count(*) OVER (PARTITION BY t, lag) AS k FROM lb), e AS (SELECT *, r - m AS e FROM m WHERE k >= 3),
s AS (SELECT symbol, t, sum(CASE WHEN lag >= 24 THEN e END) AS su, count(CASE WHEN lag >= 24 THEN e END) AS n, count(e) AS al, stddev_samp(e) AS sd FROM e GROUP BY 1, 2),
c AS (SELECT dc.t, f.symbol, -sum(rate) AS carry, count(rate) AS n FROM dc JOIN fu f ON f.f >= dc.t - {72 * H} AND f.f < dc.t GROUP BY 1, 2),
j AS (SELECT s.symbol, s.t, su / sd AS momentum, c.carry FROM s JOIN c ON c.symbol = s.symbol AND c.t = s.t WHERE s.n >= 20 AND al >= 30 AND sd >= 1e-8 AND c.n >= 10),
k AS (SELECT symbol, t, 0.5 * ({rank_of('momentum')}) + 0.5 * ({rank_of('carry')}) AS score, count(*) OVER (PARTITION BY t) AS n FROM j) SELECT symbol, t, round(score, 6) AS score FROM k WHERE n > 1""")
def l3_residual(spark: SparkSession, sf: str) -> DataFrame:
    hours, funding, decisions = inputs(spark, sf)
    out = hourly_scores.residual(hours, funding, decisions, window=72, names=3, least_momentum=20, least_all=30, least_funding=10)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {HOURS}, {LOOKED.format(n=168)}, s AS (SELECT symbol, t, sqrt(avg(r * r)) AS rms, count(r) AS n FROM lb GROUP BY 1, 2),
c AS (SELECT dc.t, f.symbol, -sum(rate) AS carry, count(rate) AS n FROM dc JOIN fu f ON f.f >= dc.t - {72 * H} AND f.f < dc.t GROUP BY 1, 2),
j AS (SELECT s.symbol, s.t, c.carry, s.rms, ln(a.close / b.close) AS r FROM s JOIN c ON c.symbol = s.symbol AND c.t = s.t LEFT JOIN h a ON a.symbol = s.symbol AND a.t = s.t LEFT JOIN h b ON b.symbol = s.symbol AND b.t = s.t - {24 * H} WHERE s.n >= 60 AND c.n >= 3)
SELECT symbol, t, round(carry, 6) AS score, round(rms, 6) AS rms, round(CASE WHEN count(r) OVER (PARTITION BY t) >= 3 THEN r - median(r) OVER (PARTITION BY t) END, 6) AS excess_24h FROM j""")
def l4_carry_and_excess(spark: SparkSession, sf: str) -> DataFrame:
    hours, funding, decisions = inputs(spark, sf)
    out = hourly_scores.carry_and_excess(hours, funding, decisions, least=60, names=3)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "rms", "excess_24h")})
