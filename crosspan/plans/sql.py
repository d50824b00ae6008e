"""SQL for the panels that the registered queries read; the queries' own SQL stands on these."""

from __future__ import annotations

HOUR = 3_600_000
DAY = 24 * HOUR
STEP = {"1h": HOUR, "6h": 6 * HOUR, "1d": DAY}
COMPLETE = {"1h": 2, "6h": 10, "1d": 1}


def bars(kind: str = "6h", name: str = "bars") -> str:
    """A table ``bars`` (symbol, t in epoch ms, ...), as sources.panel makes it."""
    step, symbol = STEP[kind], "user_id::VARCHAR" if kind == "1d" else "event_type"
    taker = "sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END)"
    return f"""{name} AS (SELECT {symbol} AS symbol, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {step} AS t,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
 sum(value) / 2 AS volume, sum(value) AS quote_volume, count(*) AS trades, {taker} / 2 AS taker_buy_volume, {taker} AS taker_buy_quote_volume,
 count(*) >= {COMPLETE[kind]} AS is_complete FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""


def segments(kind: str = "6h", source: str = "bars") -> str:
    """``seg``: bars with their gap segment and the segment's bar before."""
    return f"""brk AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w <> {STEP[kind]} OR NOT is_complete OR NOT lag(is_complete) OVER w THEN 1 ELSE 0 END AS b
 FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY t)),
sg AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY t) AS segment FROM brk),
seg AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(volume) OVER w AS v1, close - lag(close) OVER w AS ch,
 row_number() OVER w AS i FROM sg WINDOW w AS (PARTITION BY symbol, segment ORDER BY t))"""


def average(source: str, value: str, alpha: float, out: str, least: int, into: str) -> str:
    """``into``: ``source`` with the exponential average of ``value`` as a weighted sum over its past."""
    return f"""{into}_k AS (SELECT symbol, segment, t, {value} AS x, row_number() OVER (PARTITION BY symbol, segment ORDER BY t) AS k FROM {source} WHERE {value} IS NOT NULL),
{into}_y AS (SELECT a.symbol, a.segment, a.t, a.k, sum(b.x * (CASE WHEN b.k = 1 THEN 1.0 ELSE {alpha!r} END) * pow({1 - alpha!r}, a.k - b.k)) AS y
 FROM {into}_k a JOIN {into}_k b ON a.symbol = b.symbol AND a.segment = b.segment AND b.k <= a.k GROUP BY 1, 2, 3, 4),
{into} AS (SELECT s.*, CASE WHEN y.k >= {least} THEN y.y END AS {out} FROM {source} s LEFT JOIN {into}_y y ON s.symbol = y.symbol AND s.segment = y.segment AND s.t = y.t)"""
