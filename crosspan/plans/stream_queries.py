"""Registered queries of the streaming jobs; each stands against the batch result's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import ms
from crosspan.functions.work import shared
from crosspan.plans import factor_queries, sql
from crosspan.plans.research_queries import SCORES, SNAP, START, scores
from crosspan.sources import panel
from crosspan.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, H6 = sql.DAY, sql.STEP["6h"]
MIDDLE = START + 15 * D


def query(text: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


def streamed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` put into files, as a stream."""
    path = shared(spark, name)
    df.write.parquet(path)
    return jobs.source(spark, path)


def events(spark: SparkSession, sf: str) -> DataFrame:
    panel.utc(spark)
    raw = jobs.source(spark, f"{sf}/events.parquet*")  # a file or a folder
    return raw.where("value is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "event_id", "value")


LAST = "(SELECT max(epoch_us(ts)) FROM events WHERE value IS NOT NULL)"


@query(f"WITH {sql.bars('6h')} SELECT symbol, t, open, high, low, close, trades FROM bars WHERE (t + {H6}) * 1000 <= {LAST} - 3600000000")
def z1_stream_resample(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_available(jobs.resample(events(spark, sf), "6h", "1 hour"), shared(spark, "z1"))
    return out.select("symbol", ms("open_time").alias("t"), "open", "high", "low", "close", "trades")


@query(f"WITH {sql.bars('1h')} SELECT symbol, t FROM bars")
def z2_stream_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1h").select("symbol", "open_time", "close")
    stream = streamed(spark, bars.unionByName(bars.where("close > 10")), "bars")
    out = jobs.run_available(jobs.without_duplicates(stream, "1 day"), shared(spark, "z2"))
    return out.select("symbol", ms("open_time").alias("t"))


@query(f"WITH {sql.bars('1h')}, ls AS (SELECT symbol, max(t) AS m FROM bars GROUP BY 1) SELECT symbol, t, close FROM bars JOIN ls USING (symbol) WHERE t >= {MIDDLE} OR m < {MIDDLE}")
def z2_stream_rewinds(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the bars comes first, then all of them again: what is older is rewound."""
    bars = panel.bars(spark, sf, "1h").select("symbol", "open_time", "close")
    path, out = shared(spark, "bars"), shared(spark, "z2")
    for part in (bars.where(ms("open_time") >= MIDDLE), bars):
        part.write.mode("append").parquet(path)
        rows = jobs.run_available(jobs.forward_only(jobs.source(spark, path), "60 days"), out)
    return rows.select("symbol", "t", "close")


@query(f"WITH {sql.bars('1h')} SELECT symbol, sum(CASE WHEN is_complete THEN 1 ELSE 0 END)::BIGINT AS history_bars, min(t) AS first_t FROM bars GROUP BY 1")
def z3_stream_history(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_available(jobs.history(streamed(spark, panel.bars(spark, sf, "1h"), "bars")), shared(spark, "z3"))
    return out.groupBy("symbol").agg(F.max("history_bars").alias("history_bars"), F.min(ms("first_bar_open")).alias("first_t"))


@query(factor_queries.SQL["f9_live_ema_ratio"])
def z4_stream_live_ema(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_available(jobs.live_ema(streamed(spark, panel.bars(spark, sf, "6h"), "bars"), "6h", "1d", 2, 4), shared(spark, "z4"))
    return out.where("raw_value is not null").select("symbol", "t", F.round("raw_value", 6).alias("value"))


def halves(spark: SparkSession, sf: str, interval: str) -> tuple[DataFrame, DataFrame]:
    """Bars that a batch has seen, and a stream of the later ones."""
    bars = panel.bars(spark, sf, interval)
    return bars.where(ms("open_time") < MIDDLE), streamed(spark, bars.where(ms("open_time") >= MIDDLE), "bars")


@query(f"WITH {sql.bars('1h')} SELECT symbol, sum(CASE WHEN is_complete THEN 1 ELSE 0 END)::BIGINT AS history_bars, min(t) AS first_t FROM bars GROUP BY 1 HAVING max(t) >= {MIDDLE}")
def z3_stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    seen, later = halves(spark, sf, "1h")
    out = jobs.run_available(jobs.history(later, initial=jobs.history_state(seen)), shared(spark, "z3"))
    return out.groupBy("symbol").agg(F.max("history_bars").alias("history_bars"), F.min(ms("first_bar_open")).alias("first_t"))


@query(f"SELECT * FROM ({factor_queries.SQL['f9_live_ema_ratio']}) WHERE t > {MIDDLE}")
def z4_stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    seen, later = halves(spark, sf, "6h")
    state = jobs.live_ema_state(seen, "1d", "6h", 2, 4)
    out = jobs.run_available(jobs.live_ema(later, "6h", "1d", 2, 4, initial=state), shared(spark, "z4"))
    return out.where("raw_value is not null").select("symbol", "t", F.round("raw_value", 6).alias("value"))


@query(f"WITH {SCORES}, p AS (SELECT symbol, t, value, CASE WHEN t - lag(t) OVER w = {D} THEN lag(value) OVER w END AS pv FROM sc WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, t, round(value, 6) AS score, CASE WHEN pv <= 0.2 AND value > 0.2 THEN 'LONG' ELSE 'FLAT' END AS side FROM p WHERE (pv <= 0.2 AND value > 0.2) OR (pv >= -0.2 AND value < -0.2)")
def z5_stream_crossover(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_available(jobs.crossover_alerts(streamed(spark, scores(spark, sf), "scores"), 0.2, -0.2, "1d"), shared(spark, "z5"))
    return out.withColumn("score", F.round("score", 6))


def stream_ranks(spark: SparkSession, sf: str) -> str:
    """Where the ranks of all timestamps are; a row far ahead lets the watermark close the last ones."""
    path, out = shared(spark, "scores"), shared(spark, "z6")
    rows = scores(spark, sf).select("timestamp", "symbol", "value", "is_valid")
    rows.write.parquet(path)
    jobs.run_available(jobs.rank_snapshots(jobs.source(spark, path), "1 day"), out)
    ahead = rows.agg(F.max("timestamp").alias("timestamp")).where("timestamp is not null").select((F.col("timestamp") + F.expr("interval 30 days")).alias("timestamp"), F.lit("").alias("symbol"), F.lit(0.0).alias("value"), F.lit(True).alias("is_valid"))
    ahead.write.mode("append").parquet(path)
    jobs.run_available(jobs.rank_snapshots(jobs.source(spark, path), "1 day"), out)
    return f"{out}/out"


@query(f"WITH {SCORES}, {SNAP} SELECT symbol, t, rk AS ordinal_rank, n AS sample_count FROM snap")
def z6_stream_ranks(spark: SparkSession, sf: str) -> DataFrame:
    out = spark.read.parquet(stream_ranks(spark, sf))
    return out.select("symbol", ms("timestamp").alias("t"), F.col("ordinal_rank").cast("long"), F.col("sample_count").cast("long"))


@query(f"""WITH {SCORES}, {SNAP}, tens AS (SELECT symbol, t, (rk + 9) // 10 AS g FROM snap),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w = {D} AND g <= lag(g) OVER w THEN 0 ELSE 1 END AS b FROM tens WINDOW w AS (PARTITION BY symbol ORDER BY t)),
i AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY t) AS isl FROM f), j AS (SELECT *, first(g) OVER w AS f0, row_number() OVER w AS pos FROM i WINDOW w AS (PARTITION BY symbol, isl ORDER BY t)),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY t) AS k FROM j WHERE f0 >= 6 AND pos > 1 AND g = 2) SELECT symbol, t, g AS ordinal_rank FROM h WHERE k = 1""")
def z6_stream_descents(spark: SparkSession, sf: str) -> DataFrame:
    ranks = jobs.source(spark, stream_ranks(spark, sf)).withColumn("ordinal_rank", F.floor((F.col("ordinal_rank") + 9) / 10))
    return jobs.run_available(jobs.descent_alerts(ranks, 6, 2, "1d"), shared(spark, "z6"))


@query(f"WITH {sql.bars('6h')}, fu AS (SELECT event_id, event_type AS symbol, epoch_us(ts) AS ft FROM events WHERE value IS NOT NULL) SELECT f.event_id, f.symbol, b.t, b.close FROM fu f JOIN bars b ON b.symbol = f.symbol AND f.ft > b.t * 1000 AND f.ft <= (b.t + {H6}) * 1000")
def z7_stream_funding_join(spark: SparkSession, sf: str) -> DataFrame:
    f = streamed(spark, panel.funding(spark, sf).select("funding_time", "symbol", "event_id"), "funding")
    out = jobs.run_available(jobs.funding_join(f, streamed(spark, panel.bars(spark, sf, "6h"), "bars"), "6h", "1 day"), shared(spark, "z7"))
    return out.select("event_id", "symbol", ms("open_time").alias("t"), "close")
