"""Registered queries of time-axis, join, quality and source operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.functions.core import ms
from crosspan.functions.work import shared
from crosspan.operators import quality, timeaxis, universe
from crosspan.plans import sql
from crosspan.plans.research_queries import CONTRACTS, END, START, everyone, scores
from crosspan.sources import files, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, HOUR, H6 = sql.DAY, sql.HOUR, sql.STEP["6h"]


def query(text: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


B1, B6, BD = sql.bars("1h"), sql.bars("6h"), sql.bars("1d")


@query(f"WITH {B1}, {sql.segments('1h')} SELECT symbol, t, segment::BIGINT AS segment FROM sg")
def t1_segments(spark: SparkSession, sf: str) -> DataFrame:
    return timeaxis.segments(panel.bars(spark, sf, "1h"), "1h").select("symbol", ms("open_time").alias("t"), "segment")




@query(f"WITH {B1} SELECT symbol, b AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, round(sum(quote_volume), 4) AS quote_volume, sum(trades)::BIGINT AS trades, bool_and(is_complete) AND count(*) = 4 AND min(t) = b AS is_complete FROM (SELECT *, t - t % {4 * HOUR} AS b FROM bars) GROUP BY symbol, b")
def t2_resample(spark: SparkSession, sf: str) -> DataFrame:
    r = timeaxis.resample(panel.bars(spark, sf, "1h"), "1h", "4h")
    return r.select("symbol", ms("open_time").alias("t"), "open", "high", "low", "close", F.round("quote_volume", 4).alias("quote_volume"), "trades", "is_complete")


@query(f"WITH {BD} SELECT symbol, b AS t, first(open ORDER BY t) AS open, last(close ORDER BY t) AS close, bool_and(is_complete) AND count(*) = 7 AND min(t) = b AS is_complete FROM (SELECT *, t - (t - {4 * D}) % {7 * D} AS b FROM bars) GROUP BY symbol, b")
def t3_resample_marks_weekly(spark: SparkSession, sf: str) -> DataFrame:
    r = timeaxis.resample(panel.bars(spark, sf, "1d"), "1d", "1w", volumes=False)
    return r.select("symbol", ms("open_time").alias("t"), "open", "close", "is_complete")


@query(f"WITH {B1} SELECT symbol, t + {HOUR} AS t, close, 1::BIGINT AS minute_count, round(quote_volume, 4) AS quote_volume FROM bars")
def t4_hour_bars(spark: SparkSession, sf: str) -> DataFrame:
    return timeaxis.hour_bars(panel.bars(spark, sf, "1h")).select("symbol", ms("available_at").alias("t"), "close", "minute_count", F.round("quote_volume", 4).alias("quote_volume"))


@query(f"WITH {BD} SELECT s.symbol, g.t FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT unnest(generate_series({START + 5 * D}, {END - 1}, {6 * D})) AS t) g")
def t5_schedule_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    symbols = panel.bars(spark, sf, "1d").select("symbol").distinct()
    # J4: the schedule is a bounded sequence, so each symbol unfolds it.
    return symbols.join(F.broadcast(timeaxis.schedule(spark, START + 5 * D, END, "6d"))).select("symbol", ms("timestamp").alias("t"))


@query(f"WITH {B1} SELECT symbol, t + {HOUR} AS t, close FROM bars WHERE (t + {HOUR}) % {8 * HOUR} = 0")
def t6_thin_clock(spark: SparkSession, sf: str) -> DataFrame:
    return timeaxis.thin(panel.bars(spark, sf, "1h"), "8h", "close_time").select("symbol", ms("close_time").alias("t"), "close")


@query(f"WITH {B1} SELECT t, t + {HOUR} AS close_t, true AS consistent, count(*) AS bars FROM bars GROUP BY t")
def t7_market_clock(spark: SparkSession, sf: str) -> DataFrame:
    return timeaxis.market_clock(panel.bars(spark, sf, "1h")).select(ms("open_time").alias("t"), ms("close_time").alias("close_t"), "consistent", "bars")


@query(f"WITH {B1} SELECT s.symbol, s.t + {HOUR} AS t, b.t AS fill_t, b.open AS fill_price FROM bars s JOIN bars b ON b.symbol = s.symbol AND b.t = s.t + {2 * HOUR} AND b.is_complete WHERE s.close > s.open")
def t8_fills(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1h")
    signals = bars.where("close > open").select("symbol", F.col("close_time").alias("timestamp"))
    return timeaxis.fills(signals, bars, "1h", 2).select("symbol", ms("timestamp").alias("t"), ms("fill_time").alias("fill_t"), "fill_price")


EVERY = f"syms AS (SELECT DISTINCT symbol FROM bars), grid AS (SELECT symbol, g.t FROM syms, (SELECT unnest(generate_series({START + 2 * D}, {END - 1}, {3 * D})) AS t) g)"


def grid(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return panel.bars(spark, sf, kind).select("symbol").distinct().join(F.broadcast(timeaxis.schedule(spark, START + 2 * D, END, "1d").where((ms("timestamp") - START - 2 * D) % (3 * D) == 0)))


@query(f"WITH {BD}, {EVERY}, marks AS (SELECT symbol, t + {D} AS ct, close FROM bars) SELECT g.symbol, g.t, m.close AS carried_close FROM grid g ASOF LEFT JOIN marks m ON g.symbol = m.symbol AND g.t > m.ct")
def t9_carried_close_strict(spark: SparkSession, sf: str) -> DataFrame:
    out = timeaxis.carried_close(grid(spark, sf, "1d"), panel.bars(spark, sf, "1d"), strict=True)
    return out.select("symbol", ms("timestamp").alias("t"), "carried_close")


@query(f"WITH {BD}, {CONTRACTS}, {EVERY} SELECT g.symbol, g.t, s.st AS snapshot_t, s.status, s.delivery AS delivery_t FROM grid g ASOF LEFT JOIN snaps s ON g.symbol = s.symbol AND g.t >= s.st")
def j2_asof_contracts(spark: SparkSession, sf: str) -> DataFrame:
    out = timeaxis.asof(grid(spark, sf, "1d"), panel.contracts(spark, sf), "timestamp", "snapshot_time", ["symbol"])
    return out.select("symbol", ms("timestamp").alias("t"), ms("snapshot_time").alias("snapshot_t"), "status", ms("delivery_time").alias("delivery_t"))


@query(f"WITH {BD}, {CONTRACTS}, {EVERY} SELECT g.symbol, g.t, s.st AS snapshot_t, s.status, s.delivery AS delivery_t FROM grid g ASOF LEFT JOIN snaps s ON g.symbol = s.symbol AND g.t >= s.st")
def j2_asof_split(spark: SparkSession, sf: str) -> DataFrame:
    out = timeaxis.asof(grid(spark, sf, "1d"), panel.contracts(spark, sf), "timestamp", "snapshot_time", ["symbol"], every="5d")
    return out.select("symbol", ms("timestamp").alias("t"), ms("snapshot_time").alias("snapshot_t"), "status", ms("delivery_time").alias("delivery_t"))


@query(f"WITH {B6}, fu AS (SELECT event_id, event_type AS symbol, (epoch_us(ts) // 1000) AS ft FROM events WHERE value IS NOT NULL) SELECT f.event_id, f.symbol, b.t, b.close FROM fu f JOIN bars b ON b.symbol = f.symbol AND f.ft > b.t AND f.ft <= b.t + {H6}")
def j5_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    out = timeaxis.interval_join(panel.funding(spark, sf), panel.bars(spark, sf, "6h"), "funding_time", "6h")
    return out.select("event_id", "symbol", ms("open_time").alias("t"), "close")


@query(f"WITH {B1}, a AS (SELECT symbol, t, close FROM bars WHERE close >= open), b AS (SELECT symbol, t, open FROM bars WHERE close <= open) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.t, b.t) AS t, a.close, b.open FROM a FULL JOIN b ON a.symbol = b.symbol AND a.t = b.t")
def j7_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1h").withColumn("t", ms("open_time"))
    return bars.where("close >= open").select("symbol", "t", "close").join(bars.where("close <= open").select("symbol", "t", "open"), ["symbol", "t"], "full_outer")


@query(f"WITH {B1} SELECT symbol, t FROM bars b WHERE EXISTS (SELECT 1 FROM bars x WHERE x.symbol = 'click' AND x.t = b.t) AND symbol IN ('view', 'error')")
def j8_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    bars = panel.bars(spark, sf, "1h")
    return bars.where(F.col("symbol").isin("view", "error")).join(bars.where("symbol = 'click'").select("open_time"), "open_time", "left_semi").select("symbol", ms("open_time").alias("t"))


@query("SELECT symbol FROM (SELECT DISTINCT user_id::VARCHAR AS symbol FROM events UNION SELECT DISTINCT o_custkey::VARCHAR FROM orders)")
def s1_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    users = panel.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol"))
    return users.unionByName(panel.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("symbol"))).distinct()


@query("SELECT c_custkey::VARCHAR AS symbol FROM customer EXCEPT SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'P'")
def s2_difference(spark: SparkSession, sf: str) -> DataFrame:
    have = panel.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("symbol"))
    return panel.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("symbol")).subtract(have)


@query(f"WITH {B6} SELECT symbol, t, close FROM bars ORDER BY close DESC, symbol, t LIMIT 10")
def s3_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    return timeaxis.latest(panel.bars(spark, sf, "6h"), 10, F.desc("close"), F.asc("symbol"), F.asc("open_time")).select("symbol", ms("open_time").alias("t"), "close")


# ------------------------------------------------------------------------------------- quality


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with faults by rule, and repeated keys."""
    b = panel.bars(spark, sf, "1h")
    t = F.col("trades")
    b = b.withColumns({
        "high": F.when(t % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(t % 7 == 0, -F.col("volume")).otherwise(F.col("volume")),
        "close": F.when(t % 6 == 0, F.lit(None)).otherwise(F.col("close")), "quote_volume": F.when(t % 4 == 0, F.lit(float("nan"))).otherwise(F.col("quote_volume")),
        "open": F.when(t % 8 == 0, F.lit(0.0)).otherwise(F.col("open")),
    })
    return b.unionByName(b.where("trades % 3 = 0"))


DIRTY = f"""{B1}, d0 AS (SELECT symbol, t, trades, CASE WHEN trades % 8 = 0 THEN 0.0 ELSE open END AS open, CASE WHEN trades % 5 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN trades % 6 = 0 THEN NULL ELSE close END AS close, CASE WHEN trades % 7 = 0 THEN -volume ELSE volume END AS volume,
 CASE WHEN trades % 4 = 0 THEN 'nan'::DOUBLE ELSE quote_volume END AS quote_volume, taker_buy_volume, taker_buy_quote_volume FROM bars), dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE trades % 3 = 0)"""


@query(f"WITH {DIRTY} SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, t FROM dirty)))::BIGINT AS duplicate_keys FROM dirty")
def q1_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(dirty(spark, sf))


CHECKS = f"""ck AS (SELECT count(*) AS rows, count(*) FILTER (WHERE close IS NULL) AS null_close, count(*) FILTER (WHERE isnan(quote_volume)) AS non_finite_quote_volume, count(*) FILTER (WHERE NOT (low <= least(open, close) AND greatest(open, close) <= high)) AS bad_ohlc,
 count(*) FILTER (WHERE coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)) AS non_positive_price, count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE taker_buy_volume > volume + 1e-12) AS taker_over_volume FROM dirty)"""


@query(f"WITH {DIRTY}, {CHECKS} SELECT * FROM ck")
def q2_row_checks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.checks(dirty(spark, sf)).select("rows", "null_close", "non_finite_quote_volume", "bad_ohlc", "non_positive_price", "negative_volume", "taker_over_volume")


@query(f"WITH {B1}, d AS (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS d FROM bars) SELECT symbol, '1h' AS interval, count(*) AS rows, count(*) FILTER (WHERE d <= 0 OR d % {HOUR} <> 0) AS inconsistent, coalesce(sum(CASE WHEN d > {HOUR} THEN d // {HOUR} - 1 END), 0)::BIGINT AS missing, round(coalesce(sum(CASE WHEN d > {HOUR} THEN d // {HOUR} - 1 END), 0) / (count(*) + coalesce(sum(CASE WHEN d > {HOUR} THEN d // {HOUR} - 1 END), 0))::DOUBLE, 6) AS missing_ratio FROM d GROUP BY 1")
def q7_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gaps(panel.bars(spark, sf, "1h")).withColumn("missing_ratio", F.round("missing_ratio", 6))


@query(f"WITH {DIRTY}, {CHECKS} SELECT concat_ws(',', CASE WHEN null_close > 0 THEN 'NULL_CLOSE' END, CASE WHEN bad_ohlc > 0 THEN 'BAD_OHLC' END, CASE WHEN negative_volume > 1000000 THEN 'NEGATIVE_VOLUME' END) AS errors, null_close = 0 AND bad_ohlc = 0 AND negative_volume <= 1000000 AS passed FROM ck")
def q8_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gate(quality.checks(dirty(spark, sf)), {"null_close": 0, "bad_ohlc": 0, "negative_volume": 1_000_000})


def catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(partitions, sources, objects): a partition a day and version, a raw object a symbol and day."""
    b = panel.bars(spark, sf, "6h")
    day = F.floor(ms("open_time") / D)
    v = F.concat(F.lit("v"), (day % 3).cast("string"))
    p = b.groupBy(v.alias("dataset_version"), F.concat_ws("/", F.lit("p"), day).alias("partition_id")).agg(F.lit("6h").alias("interval"), F.count("*").alias("row_count"), F.min("open_time").alias("min_time"), F.max("open_time").alias("max_time"), F.count_distinct("symbol").alias("symbols"), F.concat(F.lit("r"), F.max(day % 2)).alias("quality_report_id"))
    o = b.where("is_complete").select(F.concat_ws("/", "symbol", day).alias("object_id"), "symbol", F.concat_ws("/", F.lit("p"), day).alias("partition_id")).distinct()
    return p, o.select("partition_id", "object_id"), o.select("object_id", "symbol")


CATALOG = f"""{B6}, c0 AS (SELECT *, t // {D} AS d FROM bars), parts AS (SELECT 'v' || (d % 3) AS dataset_version, 'p/' || d AS partition_id, count(*) AS row_count, min(t) AS mn, max(t) AS mx, count(DISTINCT symbol) AS symbols, 'r' || max(d % 2) AS rep FROM c0 GROUP BY 1, 2),
objs AS (SELECT DISTINCT symbol || '/' || d AS object_id, symbol, 'p/' || d AS partition_id FROM c0 WHERE is_complete)"""


@query(f"WITH {CATALOG} SELECT dataset_version, count(*) AS partitions, sum(row_count)::BIGINT AS rows, min(mn) AS min_t, max(mx) AS max_t, max(symbols) AS max_symbols, count(DISTINCT rep) AS reports FROM parts GROUP BY 1")
def q9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = quality.coverage(catalog(spark, sf)[0])
    return c.select("dataset_version", "partitions", "rows", ms("min_time").alias("min_t"), ms("max_time").alias("max_t"), "max_symbols", "reports")


@query(f"WITH {CATALOG} SELECT dataset_version, '6h' AS interval, count(*) AS partitions, sum(row_count)::BIGINT AS rows FROM parts GROUP BY 1")
def q10_coverage_list(spark: SparkSession, sf: str) -> DataFrame:
    c = quality.coverage(catalog(spark, sf)[0].where("interval = '6h'"), ("dataset_version", "interval")).orderBy("dataset_version")
    return c.select("dataset_version", "interval", "partitions", "rows")


@query(f"WITH {CATALOG} SELECT DISTINCT dataset_version, symbol FROM parts JOIN objs USING (partition_id)")
def q11_symbols_behind(spark: SparkSession, sf: str) -> DataFrame:
    return quality.symbols_behind(*catalog(spark, sf))


@query(f"WITH {CATALOG}, req AS (SELECT * FROM (SELECT unnest(['v0', 'v1', 'v9']) AS dataset_version), (SELECT unnest(['click', 'nobody']) AS symbol)), cv AS (SELECT dataset_version, min(mn) AS mn, max(mx) AS mx FROM parts GROUP BY 1), hv AS (SELECT DISTINCT dataset_version, symbol FROM parts JOIN objs USING (partition_id)) SELECT r.dataset_version, r.symbol, CASE WHEN NOT coalesce(mn <= {START + 5 * D} AND mx >= {START + 25 * D}, false) THEN 'WINDOW_NOT_COVERED' WHEN h.symbol IS NULL THEN 'SYMBOL_MISSING' ELSE 'OK' END AS status FROM req r LEFT JOIN cv USING (dataset_version) LEFT JOIN hv h ON h.dataset_version = r.dataset_version AND h.symbol = r.symbol")
def q12_requirements(spark: SparkSession, sf: str) -> DataFrame:
    p, s, o = catalog(spark, sf)
    asked = spark.createDataFrame([(v, x) for v in ("v0", "v1", "v9") for x in ("click", "nobody")], "dataset_version string, symbol string")
    asked = asked.withColumns({"start": F.timestamp_millis(F.lit(START + 5 * D)), "end": F.timestamp_millis(F.lit(START + 25 * D))})
    return quality.requirements(asked, quality.coverage(p), quality.symbols_behind(p, s, o))


@query(f"WITH {CATALOG}, ex AS (SELECT symbol, d FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(generate_series({START // D - 2}, {START // D + 19})) AS d)), iv AS (SELECT DISTINCT symbol, d, d % 5 <> 0 AS man, CASE WHEN d % 7 = 0 THEN 'x' ELSE 'y' END AS cs FROM c0 WHERE is_complete) SELECT coalesce(e.symbol, i.symbol) AS symbol, coalesce(e.d, i.d) AS day, CASE WHEN i.symbol IS NULL THEN 'missing' WHEN e.symbol IS NULL THEN 'orphan' WHEN NOT man THEN 'unmanifested' WHEN cs = 'y' THEN 'verified' ELSE 'conflict' END AS status FROM ex e FULL JOIN iv i ON e.symbol = i.symbol AND e.d = i.d")
def q13_inventory(spark: SparkSession, sf: str) -> DataFrame:
    b = panel.bars(spark, sf, "6h").withColumn("day", F.floor(ms("open_time") / D))
    expected = b.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(START // D - 2), F.lit(START // D + 19))).alias("day"))
    have = b.where("is_complete").select("symbol", "day").distinct().withColumns({"manifested": F.col("day") % 5 != 0, "checksum": F.when(F.col("day") % 7 == 0, "x").otherwise("y"), "manifest_checksum": F.lit("y")})
    return quality.inventory_status(expected, have, ["symbol", "day"])


@query(f"WITH {CATALOG} SELECT DISTINCT object_id AS source, partition_id AS target, 'raw' AS kind FROM objs UNION SELECT partition_id, dataset_version, 'partition' FROM parts UNION SELECT dataset_version, dataset_version || '/6h', 'derived' FROM parts")
def q14_lineage(spark: SparkSession, sf: str) -> DataFrame:
    p, s, _ = catalog(spark, sf)
    return quality.lineage(p, s)


@query(f"WITH {BD}, f AS (SELECT symbol, t, CASE WHEN t - lag(t, 2) OVER w = {2 * D} AND close > 0 AND lag(close, 2) OVER w > 0 THEN 1 ELSE 0 END AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (SELECT t, count(*) AS n, sum(v) AS v FROM f GROUP BY t) SELECT (SELECT count(DISTINCT symbol) FROM bars) AS symbols, (SELECT count(DISTINCT symbol) FROM bars) AS eligible_symbols, sum(n)::BIGINT AS factor_rows, sum(v)::BIGINT AS valid_rows, min(v)::BIGINT AS ranked_min, max(v)::BIGINT AS ranked_max FROM g")
def q16_panel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.panel_stats(everyone(panel.bars(spark, sf, "1d")), scores(spark, sf))


# ------------------------------------------------------------------------------- sources, sinks


def published(spark: SparkSession, sf: str) -> str:
    path = shared(spark, "bars")
    files.publish(panel.bars(spark, sf, "1h"), path)
    return path


@query(f"WITH {B1} SELECT symbol, t, close FROM bars WHERE t >= {START + 3 * D} AND t < {START + 9 * D} AND symbol IN ('click', 'view')")
def io1_publish_and_scan(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda d: F.timestamp_millis(F.lit(START + d * D))
    out = files.scan(spark, published(spark, sf), files.BARS, "events-v1", "open_time", at(3), at(9), "1h", ["symbol", "open_time", "close"], ["click", "view"])
    return out.select("symbol", ms("open_time").alias("t"), "close")


def by_symbol_published(spark: SparkSession, sf: str, interval: str, columns: list[str]) -> DataFrame:
    """All bars, published and read back partitioned by symbol."""
    path = shared(spark, "bars")
    files.publish_by_symbol(panel.bars(spark, sf, interval), path, 8)
    at = lambda t: F.timestamp_millis(F.lit(t))
    return files.scan_by_symbol(spark, path, 8, "events-v1", at(0), at(files.EPOCH_MS[1]), interval, columns)


@query(f"WITH {B1}, {sql.segments('1h')} SELECT symbol, t, segment::BIGINT AS segment FROM sg")
def io11_segments_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    bars = by_symbol_published(spark, sf, "1h", ["symbol", "open_time", "is_complete"])
    return timeaxis.segments(bars, "1h").select("symbol", ms("open_time").alias("t"), "segment")


@query(f"WITH {BD} SELECT symbol, t + {D} AS t, sum(CASE WHEN is_complete THEN 1 ELSE 0 END) OVER w::BIGINT AS history_bars, min(t) OVER w AS first_t, round(sum(CASE WHEN is_complete THEN quote_volume ELSE 0 END) OVER w, 4) AS quote FROM bars WHERE t >= {START + 4 * D} AND t < {START + 25 * D} WINDOW w AS (PARTITION BY symbol ORDER BY t)")
def io11_history_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Of a stretch of time, as a later run would read it."""
    path = shared(spark, "bars")
    files.publish_by_symbol(panel.bars(spark, sf, "1d"), path, 8)
    at = lambda d: F.timestamp_millis(F.lit(START + d * D))
    h = universe.running_history(files.scan_by_symbol(spark, path, 8, "events-v1", at(4), at(25), "1d"))
    return h.select("symbol", ms("close_time").alias("t"), "history_bars", ms("first_bar_open").alias("first_t"), F.round("cumulative_quote", 4).alias("quote"))


@query(f"WITH {B1} SELECT symbol, t, open, close FROM bars WHERE t >= {START + 2 * D} AND t < {START + 8 * D}")
def io2_scan_marks(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "marks")
    panel.bars(spark, sf, "1h").select(*files.names(files.MARKS)).write.parquet(path)
    at = lambda d: F.timestamp_millis(F.lit(START + d * D))
    out = files.scan(spark, path, files.MARKS, "events-v1", "open_time", at(2), at(8), "1h")
    return out.select("symbol", ms("open_time").alias("t"), "open", "close")


@query(f"WITH {CONTRACTS} SELECT symbol, st AS snapshot_t, contract_type, status FROM snaps WHERE st >= {START + 5 * D} AND st < {START + 25 * D}")
def io4_scan_contracts(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "contracts")
    missing = {c: F.lit(None).cast(k) for c, k in (part.split(" ") for part in files.CONTRACTS.split(", "))}
    have = panel.contracts(spark, sf)
    have.select(*(have[c] if c in have.columns else missing[c].alias(c) for c in files.names(files.CONTRACTS))).write.parquet(path)
    at = lambda d: F.timestamp_millis(F.lit(START + d * D))
    out = files.scan(spark, path, files.CONTRACTS, "orders-v1", "snapshot_time", at(5), at(25))
    return out.select("symbol", ms("snapshot_time").alias("snapshot_t"), "contract_type", "status")


@query(f"WITH fu AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS t, round((value % 1 - 0.5) / 100, 9) AS funding_rate FROM events WHERE value IS NOT NULL) SELECT symbol, t, funding_rate FROM fu WHERE t >= {START + 3 * D} AND t < {START + 9 * D}")
def io3_scan_funding(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "funding")
    panel.funding(spark, sf).select("funding_time", "symbol", "funding_rate", "mark_price", F.lit(8).alias("funding_interval_hours"), F.lit("events").alias("source_object_id"), "dataset_version").write.parquet(path)
    at = lambda d: F.timestamp_millis(F.lit(START + d * D))
    out = files.scan(spark, path, files.FUNDING, "events-v1", "funding_time", at(3), at(9))
    return out.select("symbol", ms("funding_time").alias("t"), F.round("funding_rate", 9).alias("funding_rate"))


def cells(df: DataFrame) -> DataFrame:
    """Bars as klines' cells: times in ms, the close inclusive, a fault in each row with 9 or 11 trades."""
    v = lambda c: F.col(c).cast("string")
    return df.select("symbol", F.array(F.concat(F.when(F.col("trades") == 11, "x").otherwise(""), ms("open_time").cast("string")), v("open"), v("high"), v("low"), F.when(F.col("trades") == 9, "n/a").otherwise(v("close")), v("volume"), (ms("close_time") - 1).cast("string"), v("quote_volume"), v("trades"), v("taker_buy_volume"), v("taker_buy_quote_volume"), F.lit("0")).alias("c"))


@query(f"WITH {B1} SELECT symbol, t, close, trades, true AS is_complete FROM bars WHERE trades NOT IN (9, 11)")
def io6_csv_klines(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "csv")
    raw = cells(panel.bars(spark, sf, "1h"))
    head = raw.select("symbol").distinct().select("symbol", F.lit("open_time,open,high").alias("value"))
    raw.select("symbol", F.array_join("c", ",").alias("value")).unionByName(head).write.partitionBy("symbol").text(path)
    bars, _ = files.csv_klines(spark.read.text(path), "1h", "v1")
    return bars.select("symbol", ms("open_time").alias("t"), "close", "trades", "is_complete")


@query(f"WITH {B1} SELECT symbol, t, close, t + {HOUR} <= {START + 20 * D} AS is_complete FROM bars WHERE trades NOT IN (9, 11)")
def io7_json_klines(spark: SparkSession, sf: str) -> DataFrame:
    raw = cells(panel.bars(spark, sf, "1h"))
    pages = raw.groupBy("symbol", F.floor(F.get("c", F.lit(6)).cast("long") / D)).agg(F.to_json(F.collect_list("c")).alias("value"))
    bars, _ = files.json_klines(pages, "1h", "v1", F.timestamp_millis(F.lit(START + 20 * D)))
    return bars.select("symbol", ms("open_time").alias("t"), "close", "is_complete")


@query(f"WITH {B1}, p AS (SELECT *, (t + {HOUR} - 1) // {D} AS day FROM bars) SELECT symbol, (count(*) FILTER (WHERE day % 7 <> 0 AND trades IN (9, 11)) + count(DISTINCT day) FILTER (WHERE day % 7 = 0))::BIGINT AS rejects FROM p GROUP BY 1")
def io7_broken_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each seventh day are cut off: one reject each, besides the rows at fault on the others."""
    day = F.floor(F.get("c", F.lit(6)).cast("long") / D)
    pages = cells(panel.bars(spark, sf, "1h")).groupBy("symbol", day.alias("day")).agg(F.to_json(F.collect_list("c")).alias("value"))
    rejects = files.json_klines(cut_off(pages, F.col("day") % 7 == 0), "1h", "v1", F.timestamp_millis(F.lit(START + 20 * D)))[1]
    return rejects.groupBy("symbol").agg(F.count("*").alias("rejects"))


def cut_off(pages: DataFrame, test: Column) -> DataFrame:
    return pages.withColumn("value", F.when(test, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")))


@query(f"WITH {B1} SELECT symbol, count(*) AS rejects FROM bars WHERE trades IN (9, 11) GROUP BY 1")
def io10_rejects(spark: SparkSession, sf: str) -> DataFrame:
    raw = cells(panel.bars(spark, sf, "1h")).select("symbol", F.array_join("c", ",").alias("value"))
    return files.csv_klines(raw, "1h", "v1")[1].groupBy("symbol").agg(F.count("*").alias("rejects"))


def settlements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Funding as strings in both dialects, each in its own columns and one rate in 97 damaged; and hours."""
    f = panel.funding(spark, sf)
    rate = F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.format_string("%.12f", "funding_rate"))
    t, old = ms("funding_time").cast("string"), F.col("event_id") % 2 == 0
    raw = f.select("symbol", "funding_time", "event_id", F.when(old, t).alias("calc_time"), F.when(~old, t).alias("fundingTime"), F.when(old, rate).alias("last_funding_rate"), F.when(~old, rate).alias("fundingRate"))
    return raw, f.select("symbol").distinct().withColumn("funding_interval_hours", F.when(F.col("symbol") == "click", 4).otherwise(8))


def funding_columns(df: DataFrame) -> DataFrame:
    return df.select("symbol", ms("funding_time").alias("t"), F.round("funding_rate", 9).alias("funding_rate"), F.col("funding_interval_hours").alias("hours"))


FUNDING = "SELECT upper(event_type) AS symbol, (epoch_us(ts) // 1000) AS t, round((value % 1 - 0.5) / 100, 9) AS funding_rate, CASE WHEN event_type = 'click' THEN 4 ELSE 8 END AS hours FROM events WHERE value IS NOT NULL AND event_id % 97 <> 0"


def funding_pages(raw: DataFrame) -> DataFrame:
    obj = F.struct("symbol", "calc_time", "fundingTime", "last_funding_rate", "fundingRate")
    return raw.groupBy("symbol", F.floor(ms("funding_time") / D)).agg(F.to_json(F.collect_list(obj)).alias("value"))


@query(FUNDING)
def io8_funding_json(spark: SparkSession, sf: str) -> DataFrame:
    raw, hours = settlements(spark, sf)
    return funding_columns(files.funding_rows(funding_pages(raw), hours, "v1")[0])


@query(FUNDING)
def io8_funding_csv(spark: SparkSession, sf: str) -> DataFrame:
    raw, hours = settlements(spark, sf)
    old, new = shared(spark, "funding_old"), shared(spark, "funding_new")
    raw.where("calc_time is not null").select("symbol", "calc_time", "last_funding_rate").write.partitionBy("symbol").option("header", True).csv(old)
    raw.where("fundingTime is not null").select("symbol", "fundingTime", "fundingRate").write.partitionBy("symbol").option("header", True).csv(new)
    parts = [files.csv_funding(spark.read.option("header", True).csv(p), hours, "v1")[0] for p in (old, new)]
    return funding_columns(parts[0].unionByName(parts[1]))


@query("SELECT upper(event_type) AS symbol, count(*) AS rejects FROM events WHERE value IS NOT NULL AND event_id % 97 = 0 GROUP BY 1")
def io8_funding_rejects(spark: SparkSession, sf: str) -> DataFrame:
    raw, hours = settlements(spark, sf)
    return files.funding_rows(funding_pages(raw), hours, "v1")[1].groupBy("symbol").agg(F.count("*").alias("rejects"))


@query(f"SELECT coalesce(CASE WHEN day % 5 <> 0 THEN symbol END, '?') AS symbol, count(*) FILTER (WHERE day % 5 <> 0) + count(DISTINCT (symbol, day)) FILTER (WHERE day % 5 = 0) AS rejects FROM (SELECT upper(event_type) AS symbol, (epoch_us(ts) // 1000) // {D} AS day, event_id FROM events WHERE value IS NOT NULL) WHERE day % 5 = 0 OR event_id % 97 = 0 GROUP BY 1")
def io8_broken_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each fifth day are cut off and can't tell their symbol."""
    raw, hours = settlements(spark, sf)
    obj = F.struct("symbol", "calc_time", "fundingTime", "last_funding_rate", "fundingRate")
    pages = raw.groupBy("symbol", F.floor(ms("funding_time") / D).alias("day")).agg(F.to_json(F.collect_list(obj)).alias("value"))
    rejects = files.funding_rows(cut_off(pages, F.col("day") % 5 == 0), hours, "v1")[1]
    return rejects.groupBy(F.coalesce("symbol", F.lit("?")).alias("symbol")).agg(F.count("*").alias("rejects"))


@query(f"WITH {CONTRACTS} SELECT st AS snapshot_t, CASE WHEN st // {D} % 4 = 0 THEN 1 ELSE count(*) FILTER (WHERE symbol LIKE '%7') END AS rejects FROM snaps GROUP BY 1 HAVING rejects > 0")
def io9_broken_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of each fourth day is cut off."""
    pages = cut_off(contract_pages(spark, sf, 1), F.floor(ms("snapshot_time") / D) % 4 == 0)
    return files.contract_rows(pages, "v1")[1].groupBy(ms("snapshot_time").alias("snapshot_t")).agg(F.count("*").alias("rejects"))


@query(f"WITH {CONTRACTS} SELECT 'C' || symbol AS symbol, st AS snapshot_t, contract_type, status, quote_asset, onboard AS onboard_t, 0.01::DOUBLE AS price_tick, 0.001::DOUBLE AS quantity_step, 5.0::DOUBLE AS min_notional FROM snaps WHERE symbol NOT LIKE '%7'")
def io9_contract_json(spark: SparkSession, sf: str) -> DataFrame:
    out = files.contract_rows(contract_pages(spark, sf), "v1")[0]
    return out.select("symbol", ms("snapshot_time").alias("snapshot_t"), "contract_type", "status", "quote_asset", ms("onboard_time").alias("onboard_t"), "price_tick", "quantity_step", "min_notional")


@query(f"WITH {CONTRACTS} SELECT st AS snapshot_t, count(*) AS rejects FROM snaps WHERE symbol LIKE '%7' GROUP BY 1")
def io9_contract_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return files.contract_rows(contract_pages(spark, sf), "v1")[1].groupBy(ms("snapshot_time").alias("snapshot_t")).agg(F.count("*").alias("rejects"))


def contract_pages(spark: SparkSession, sf: str, parts: int = 8) -> DataFrame:
    """Snapshots as exchange metadata; symbols that end in 7 have no lot size."""
    c = panel.contracts(spark, sf)
    sizes = F.array(F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.lit("0.01").alias("tickSize"), F.lit(None).cast("string").alias("stepSize"), F.lit(None).cast("string").alias("minQty"), F.lit(None).cast("string").alias("notional")), F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit(None).cast("string").alias("tickSize"), F.lit("0.001").alias("stepSize"), F.lit("0.001").alias("minQty"), F.lit(None).cast("string").alias("notional")), F.struct(F.lit("MIN_NOTIONAL").alias("filterType"), F.lit(None).cast("string").alias("tickSize"), F.lit(None).cast("string").alias("stepSize"), F.lit(None).cast("string").alias("minQty"), F.lit("5").alias("notional")))
    row = F.struct(F.concat(F.lit("c"), "symbol").alias("symbol"), F.lower("contract_type").alias("contractType"), "status", F.lit("btc").alias("baseAsset"), F.lower("quote_asset").alias("quoteAsset"), F.col("margin_asset").alias("marginAsset"), ms("onboard_time").cast("string").alias("onboardDate"), F.filter(sizes, lambda f: ~F.col("symbol").endswith("7") | (f["filterType"] != "LOT_SIZE")).alias("filters"))
    return c.groupBy("snapshot_time", F.pmod(F.xxhash64("symbol"), F.lit(parts))).agg(F.to_json(F.struct(F.collect_list(row).alias("symbols"))).alias("value"))


@query(f"WITH {B1} SELECT '1h' AS interval, year(make_timestamp(t * 1000)) AS year, month(make_timestamp(t * 1000)) AS month, count(*) AS row_count, min(t) AS min_t, max(t) AS max_t, count(DISTINCT symbol) AS symbols FROM bars GROUP BY 1, 2, 3")
def io12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = files.manifest(spark.read.schema(files.BARS + ", year int, month int").parquet(published(spark, sf)))
    return m.select("interval", F.col("year").cast("long"), F.col("month").cast("long"), "row_count", ms("min_time").alias("min_t"), ms("max_time").alias("max_t"), "symbols")


@query(f"WITH {DIRTY} SELECT count(*) FILTER (WHERE symbol IS NULL) AS symbol, count(*) FILTER (WHERE close IS NULL) AS close FROM dirty")
def io13_conformed(spark: SparkSession, sf: str) -> DataFrame:
    return files.conformed(dirty(spark, sf), [("symbol", "string", True), ("open_time", "timestamp", False), ("close", "double", True), ("trades", "int", False)])[1]
