"""Barrier exits of entries and portfolios."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions.core import ms, seconds
from crosspan.functions.work import kept


@dataclass(frozen=True)
class Barriers:
    """Distances as shares of the entry price (None: no such barrier)."""

    stop: float | None = None
    trailing: float | None = None
    take: float | None = None
    activation: float | None = None


FAN = 16  #: blocks that make a block of the next level


def numbered(bars: DataFrame) -> DataFrame:
    """Complete bars with their place ``at`` in their symbol, from 0."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    return bars.where("is_complete").select("symbol", "open_time", "open", "high", "low", (F.row_number().over(w) - 1).cast("long").alias("at"))


def blocks(places: DataFrame, levels: int, fall: float, rise: float) -> DataFrame:
    """(symbol, level, id, low, high, falls, rises): bars (level 0), blocks of FAN bars, of FAN blocks, and so on.

    ``falls``: some low in the block is at most ``fall`` times a high before it in the block; ``rises``:
    some high is at least ``rise`` times a low before it.
    """
    one = places.select("symbol", F.lit(0).alias("level"), F.col("at").alias("id"), "low", "high", F.lit(False).alias("falls"), F.lit(False).alias("rises"))
    every = [one]
    for level in range(1, levels + 1):
        past = Window.partitionBy("symbol", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        inner = one.withColumn("parent", F.floor(F.col("id") / FAN)).withColumns({"_high": F.max("high").over(past), "_low": F.min("low").over(past)})
        one = kept(inner.groupBy("symbol", F.lit(level).alias("level"), F.col("parent").alias("id")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.bool_or(F.col("falls") | (F.col("low") <= F.col("_high") * fall)), F.lit(False)).alias("falls"), F.coalesce(F.bool_or(F.col("rises") | (F.col("high") >= F.col("_low") * rise)), F.lit(False)).alias("rises"),
        ), f"blocks_{level}")
        every.append(one)
    return reduce(DataFrame.unionByName, every)


def covering(first: Column, end: Column, levels: int) -> Column:
    """The blocks (level, id, from) that make the bars from ``first`` up to ``end``: at most 2 FAN of a level."""
    span = lambda a, b, level: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda k: F.struct(F.lit(level).alias("level"), k.alias("id"), (k * FAN**level).alias("from"))))
    parts, low, high = [], first, end
    for level in range(levels + 1):
        up, down = F.ceil(low / FAN).cast("long"), F.floor(high / FAN).cast("long")
        whole = F.lit(level == levels) | (up >= down)
        parts += [span(low, F.when(whole, high).otherwise(up * FAN), level), span(F.when(whole, high).otherwise(down * FAN), high, level)]
        low, high = F.when(whole, 0).otherwise(up).cast("long"), F.when(whole, 0).otherwise(down).cast("long")
    return F.filter(F.flatten(F.array_compact(F.array(*parts))), lambda b: b.isNotNull())


def first_bars(searches: DataFrame, table: DataFrame, levels: int, fall: float, rise: float) -> DataFrame:
    """(entry_id, search, at, best): the first bar that ends each search, if any.

    ``searches``: entry_id, search, symbol, first, end (places), kind and x. BELOW: a low of at most x;
    ABOVE: a high of at least x; FALL: a low of at most ``fall`` times the highest high before it or x;
    RISE: the mirror image. ``best``: that extreme. A search looks at the blocks that make its span,
    in order, then inside the first that ends it, level by level: some FAN rows for each level.
    """
    kind, x, low, high = F.col("kind"), F.col("x"), F.col("low"), F.col("high")
    now = searches.select("entry_id", "search", "symbol", "kind", "x", F.explode(covering(F.col("first"), F.col("end"), levels)).alias("b")).select("entry_id", "search", "symbol", "kind", "x", "b.*")
    for level in range(levels, -1, -1):
        past = Window.partitionBy("entry_id", "search").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
        met = now.join(table, ["symbol", "level", "id"])
        best = F.when(kind == "FALL", F.greatest(x, F.max("high").over(past))).when(kind == "RISE", F.least(x, F.min("low").over(past))).otherwise(x)
        met = met.withColumn("best", best)
        ends = F.when(kind == "BELOW", low <= x).when(kind == "ABOVE", high >= x).when(kind == "FALL", F.col("falls") | (low <= F.col("best") * fall)).otherwise(F.col("rises") | (high >= F.col("best") * rise))
        found = met.where(ends).groupBy("entry_id", "search", "symbol", "kind").agg(F.min_by(F.struct("level", "id", "best"), "from").alias("f")).select("entry_id", "search", "symbol", "kind", F.col("f.best").alias("x"), "f.level", "f.id")
        if not level:
            return found.select("entry_id", "search", F.col("id").alias("at"), F.col("x").alias("best"))
        inside = F.when(F.col("level") == level, F.transform(F.sequence(F.col("id") * FAN, F.col("id") * FAN + FAN - 1), lambda k: F.struct(F.lit(level - 1).alias("level"), k.alias("id"))))
        now = found.withColumn("b", F.explode(F.coalesce(inside, F.array(F.struct("level", "id"))))).select("entry_id", "search", "symbol", "kind", "x", "b.level", "b.id", F.col("b.id").alias("from"))
    raise AssertionError


def first_touch(entries: DataFrame, bars: DataFrame, interval: str, barriers: Barriers, horizon_bars: int, next_open: bool = False) -> DataFrame:
    """B1-B3. For each entry (entry_id, symbol, entry_time, side, entry_price) the first later bar that
    reaches a barrier, with reason, level and exit price.

    Of the bars in the ``horizon_bars`` intervals from the entry on. In one bar stop goes before
    trailing before take. The trailing level stands on the best price of the bars before; it holds once
    that price has moved by ``activation``. The exit is at the level, or at the open where the bar
    opens beyond it (``next_open``: at the next bar's open). Each barrier is a search for a first bar,
    by blocks: the rows an entry meets grow with the logarithm of the horizon. The bar that activates
    a trailing stop is searched first; what trails begins behind it.
    """
    step = seconds(interval) * 1000
    places = kept(numbered(bars), "places")
    levels = max(0, math.ceil(math.log(max(2, horizon_bars), FAN)) - 1)
    trailing = barriers.trailing if barriers.trailing is not None else 1.0
    fall, rise = 1.0 - trailing, 1.0 + trailing
    table = blocks(places, levels, fall, rise)
    # Places by time: how many bars of the symbol lie before the entry, and before the end of its horizon.
    begin = ms("entry_time")
    marks = entries.select("symbol", F.explode(F.array(begin, begin + horizon_bars * step)).alias("t"), F.lit(0).alias("bar")).distinct()
    w = Window.partitionBy("symbol").orderBy("t", "bar").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(places.select("symbol", ms("open_time").alias("t"), F.lit(1).alias("bar"))).withColumn("place", F.sum("bar").over(w)).where("bar = 0")
    placed = lambda t, name: counted.select("symbol", F.col("t").alias(t), F.col("place").alias(name))
    own = entries.select("entry_id", "symbol", "side", "entry_price", begin.alias("_t"), (begin + horizon_bars * step).alias("_end"))
    own = kept(own.join(placed("_t", "first"), ["symbol", "_t"]).join(placed("_end", "end"), ["symbol", "_end"]), "entries")
    e, long = F.col("entry_price"), F.col("side") == "LONG"
    sign = F.when(long, 1.0).otherwise(-1.0)
    at = lambda share, way: e * (1.0 + way * sign * share)
    against, towards = F.when(long, "BELOW").otherwise("ABOVE"), F.when(long, "ABOVE").otherwise("BELOW")
    search = lambda name, kind, x: F.struct(F.lit(name).alias("search"), kind.alias("kind"), x.alias("x"))
    fixed = [search("STOP_LOSS", against, at(barriers.stop, -1.0))] if barriers.stop is not None else []
    fixed += [search("TAKE_PROFIT", towards, at(barriers.take, 1.0))] if barriers.take is not None else []
    waits = barriers.trailing is not None and barriers.activation is not None and barriers.activation > 0
    fixed += [search("ACTIVATION", towards, at(barriers.activation, 1.0))] if waits else []
    none = own.sparkSession.createDataFrame([], own.select("entry_id", F.lit("").alias("search"), F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("best")).schema)
    found = none
    if fixed:
        each = own.select("entry_id", "symbol", "first", "end", F.explode(F.array(*fixed)).alias("s")).select("entry_id", "symbol", "first", "end", "s.*")
        found = kept(first_bars(each, table, levels, fall, rise), "touches")
    if barriers.trailing is not None:
        begun = own.withColumn("x", e)
        if waits:
            active = found.where("search = 'ACTIVATION'").select("entry_id", "at").join(own.select("entry_id", "symbol", "side", "end"), "entry_id")
            begun = active.join(places, ["symbol", "at"]).select("entry_id", "symbol", "end", "side", (F.col("at") + 1).alias("first"), F.when(F.col("side") == "LONG", F.col("high")).otherwise(F.col("low")).alias("x"))
        trails = begun.select("entry_id", F.lit("TRAILING_STOP").alias("search"), "symbol", "first", "end", F.when(F.col("side") == "LONG", "FALL").otherwise("RISE").alias("kind"), "x")
        found = found.unionByName(first_bars(trails, table, levels, fall, rise))
    order = F.when(F.col("search") == "STOP_LOSS", 0).when(F.col("search") == "TRAILING_STOP", 1).otherwise(2)
    hit = found.where("search <> 'ACTIVATION'").groupBy("entry_id").agg(F.min_by(F.struct("search", "at", "best"), F.struct("at", order.alias("o"))).alias("f")).select("entry_id", "f.*")
    opened = places.select("symbol", "at", F.col("open_time").alias("exit_bar"), "open")
    after = places.select("symbol", (F.col("at") - 1).alias("at"), F.col("open").alias("next_open"))
    out = own.join(hit, "entry_id", "left").join(opened, ["symbol", "at"], "left").join(after, ["symbol", "at"], "left")
    level = F.when(F.col("search") == "TRAILING_STOP", F.col("best") * F.when(long, fall).otherwise(rise)).otherwise(F.col("best"))
    better, worse = F.when(long, F.greatest("open", "level")).otherwise(F.least("open", "level")), F.when(long, F.least("open", "level")).otherwise(F.greatest("open", "level"))
    price = F.when(F.col("at") + 1 < F.col("end"), F.col("next_open")) if next_open else F.when(F.col("search") == "TAKE_PROFIT", better).otherwise(worse)
    return out.withColumn("level", level).select("entry_id", "symbol", "side", "exit_bar", F.coalesce("search", F.lit("NONE")).alias("reason"), "level", F.when(F.col("at").isNotNull(), price).alias("exit_price"))


def portfolio_touch(returns: DataFrame, initial: float, stop: float | None, drawdown: float | None, take: float | None, key: str = "candidate") -> DataFrame:
    """B4. The first time a candidate's equity crosses the stop, the drawdown from its peak, or the take."""
    w = Window.partitionBy(key).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    peak, e = F.greatest(F.coalesce(F.max("equity").over(w), F.lit(initial)), F.lit(initial)), F.col("equity")
    no = F.lit(False)
    why = (
        F.when(e <= initial * (1 - stop) if stop is not None else no, "PORTFOLIO_STOP_LOSS").when(e <= F.col("_peak") * (1 - drawdown) if drawdown is not None else no, "PORTFOLIO_MAX_DRAWDOWN")
        .when(e >= initial * (1 + take) if take is not None else no, "PORTFOLIO_TAKE_PROFIT")
    )
    hits = returns.withColumn("_peak", peak).withColumn("reason", why).where("reason is not null")
    return hits.groupBy(key).agg(F.min_by(F.struct("timestamp", "reason", "equity"), "timestamp").alias("h")).select(key, "h.*")
