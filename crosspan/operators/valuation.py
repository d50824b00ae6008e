"""Portfolio valuation of many candidates over one market.

All bar-level work is joins and aggregates over the spans in which a name is held. Only equity from
rebalance to rebalance is sequential, since what a trade costs depends on it; that fold is cut in time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions.core import ms, ratio, seconds
from crosspan.functions.work import kept
from crosspan.operators.factors import affine
from crosspan.operators.portfolio import snapshot_index
from crosspan.operators.timeaxis import asof, interval_join


@dataclass(frozen=True)
class Costs:
    fee_bps: float = 0.0
    slippage_bps: float = 0.0
    max_turnover: float | None = None

    @property
    def rate(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 1e4


def adverse_price(price: Column, delta: Column, slippage_bps: float) -> Column:
    """V8. The fill price moved against the trade."""
    return price * (1.0 + F.signum(delta) * slippage_bps / 1e4)


def trade_costs(trades: DataFrame, costs: Costs) -> DataFrame:
    """V8. Fee, slippage and fill price of trades (delta_notional, price)."""
    n = F.abs("delta_notional")
    return trades.withColumns({"fee": n * costs.fee_bps / 1e4, "slippage": n * costs.slippage_bps / 1e4, "fill_price": adverse_price(F.col("price"), F.col("delta_notional"), costs.slippage_bps)})


def limited(deltas: DataFrame, cap: float) -> DataFrame:
    """V7. All deltas of a candidate and time scaled so that their turnover is at most ``cap``."""
    total = F.sum(F.abs("delta")).over(Window.partitionBy("candidate", "timestamp"))
    return deltas.withColumn("delta", F.col("delta") * F.least(F.lit(1.0), F.coalesce(ratio(F.lit(cap), total), F.lit(1.0))))


def funding_cash(events: DataFrame, holdings: DataFrame, interval: str) -> DataFrame:
    """V3. Cash of settlements on (symbol, bar) holdings: -quantity * price * rate; the event's mark,
    else the bar's open."""
    placed = interval_join(events, holdings, "funding_time", interval)
    return placed.withColumn("cash", -F.col("quantity") * F.coalesce("mark_price", "open") * F.col("funding_rate"))


def boundaries(bars: DataFrame, rebalances: DataFrame, funding: DataFrame | None, interval: str) -> DataFrame:
    """V1. (open_time, next_time, idx): first bar, rebalance times, and bars with a settlement."""
    step = seconds(interval) * 1000
    times = bars.agg(F.min("open_time").alias("open_time")).union(rebalances.select(F.col("fill_time")))
    if funding is not None:
        t = ms("funding_time") - 1
        times = times.union(funding.select(F.timestamp_millis(t - t % step)))
    index = snapshot_index(times, "open_time").withColumnRenamed("timestamp", "open_time")
    end = bars.agg(F.max("close_time").alias("_end"))
    after = index.select(F.col("open_time").alias("next_time"), (F.col("idx") - 1).alias("idx"))
    return index.join(after, "idx", "left").crossJoin(end).select("open_time", F.coalesce("next_time", "_end").alias("next_time"), "idx")


FOLDED = "candidate string, idx long, symbol string, weight double, quantity double, entry_price double, mark double, equity double, turnover double, funding double, traded double"
CHUNK = 64  #: rebalances that one row folds, besides those it begins with to settle
SETTLED = 1e-17  #: the share of a wrong start that may be left


def fold(rows: DataFrame, costs: Costs, initial: float, chunk: int = CHUNK) -> DataFrame:
    """V2, V9. Equity, weights, turnover and average entry at each boundary.

    ``rows``: candidate, idx, symbol (null: the boundary alone), open (null: no real open; the mark is
    carried), mark, target (null: not named), rebalance, rate (funding at this boundary's interval). Names
    that aren't held and don't trade need no rows; every boundary needs one. At a rebalance names take
    their targets (unnamed ones 0, names without a real open stay as they are).

    Between rebalances quantities don't change, so equity there is a sum over what is held (``lots``,
    each a share of the equity that it was bought at), with a name's funding as a running sum. What is
    left to fold is a number a rebalance: see :func:`chained`. With a turnover limit every weight
    depends on those before, and :func:`capped` folds a candidate as a whole.
    """
    if costs.max_turnover is not None:
        return capped(rows, costs, initial)
    rows = rows.withColumn("idx", F.col("idx").cast("long"))
    grid = rows.groupBy("candidate", "idx").agg(F.bool_or("rebalance").alias("rebalance"))
    by_candidate = Window.partitionBy("candidate").orderBy("idx")
    grid = grid.withColumns({"turn": F.when(F.col("rebalance"), F.col("idx")), "i": F.sum(F.col("rebalance").cast("long")).over(by_candidate) - 1})
    grid = grid.withColumn("begin", F.max("turn").over(by_candidate)).select("candidate", "idx", "i", "begin")
    held = lots(rows.where("symbol is not null").join(grid, ["candidate", "idx"]))
    held = kept(held, "lots")
    equity = kept(chained(held, grid, costs.rate, chunk), "equity").withColumn("equity", F.col("equity") * initial)

    def bought(name: str) -> DataFrame:
        return equity.select("candidate", F.col("i").alias(name), F.col("equity").alias(f"{name}_equity"))

    held = held.join(bought("lot"), ["candidate", "lot"], "left").join(bought("old"), ["candidate", "old"], "left")
    held = held.withColumns({"quantity": F.coalesce(F.col("u") * F.col("lot_equity"), F.lit(0.0)), "before": F.coalesce(F.col("old_u") * F.col("old_equity"), F.lit(0.0))})
    sums = held.groupBy("candidate", "idx").agg(F.sum(F.col("quantity") * F.col("v")).alias("worth"), F.sum(-F.col("quantity") * F.col("mark") * F.coalesce("rate", F.lit(0.0))).alias("settled"))
    totals = grid.join(sums, ["candidate", "idx"], "left").join(equity, ["candidate", "i"], "left").na.fill(0.0, ["worth", "settled"])
    start, stretch = F.col("idx") == F.col("begin"), Window.partitionBy("candidate", "i").orderBy("idx")
    moved = F.col("equity") * (1.0 - costs.rate * F.col("tau")) + F.col("worth") - F.first("worth").over(stretch)
    totals = totals.withColumn("equity", F.when(F.col("i") < 0, initial).when(start, F.col("equity")).otherwise(moved))
    totals = totals.select("candidate", "idx", "equity", F.coalesce(F.when(start, F.col("tau")), F.lit(0.0)).alias("turnover"), (F.col("settled") / F.col("equity")).alias("funding"))
    out = held.join(totals, ["candidate", "idx"])
    weight, drifted = F.col("quantity") * F.col("mark") / F.col("equity"), F.col("before") * F.col("mark") / F.col("equity")
    out = out.withColumns({"weight": F.when(F.col("trades"), F.col("aim")).otherwise(weight), "drifted": drifted}).withColumn("traded", F.when(F.col("trades"), F.col("weight") - F.col("drifted")).otherwise(0.0))
    out = entries(out).where("weight <> 0 or traded <> 0")
    empty = totals.join(out.select("candidate", "idx").distinct(), ["candidate", "idx"], "left_anti")
    none = F.lit(None).cast("double")
    empty = empty.select("candidate", "idx", F.lit(None).cast("string").alias("symbol"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("quantity"), none.alias("entry_price"), none.alias("mark"), "equity", "turnover", "funding", F.lit(0.0).alias("traded"))
    return out.select(empty.columns).unionByName(empty)


def lots(rows: DataFrame) -> DataFrame:
    """``rows`` of names with what is held after (``lot``: the rebalance it was bought at; ``u``: pieces
    for each unit of equity then) and before trading (``old``, ``old_u``), the mark less funding paid so
    far (``v``) and at the rebalance before (``v_before``), whether the name trades and its new weight ``aim``."""
    w = Window.partitionBy("candidate", "symbol").orderBy("idx")
    past, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    trades = F.col("rebalance") & F.col("open").isNotNull() & ~F.isnan("open")
    target = F.when(~F.isnan("target"), F.col("target"))
    rows = rows.withColumns({"trades": trades, "aim": F.when(trades, F.coalesce(target, F.lit(0.0))), "rate": F.when(~F.isnan("rate"), F.col("rate"))})
    lot = F.when(F.col("trades"), F.struct(F.col("i").alias("lot"), (F.col("aim") / F.col("mark")).alias("u")))
    paid = F.coalesce(F.sum(F.col("mark") * F.coalesce("rate", F.lit(0.0))).over(earlier), F.lit(0.0))
    rows = rows.withColumns({"_now": F.last(lot, ignorenulls=True).over(past), "_old": F.last(lot, ignorenulls=True).over(earlier), "v": F.col("mark") - paid})
    rows = rows.withColumn("v_before", F.last(F.when(F.col("rebalance"), F.col("v")), ignorenulls=True).over(earlier))
    stuck = F.col("rebalance") & ~F.col("trades") & (F.coalesce(target, F.lit(0.0)) != 0) & (F.coalesce(F.col("_old.u"), F.lit(0.0)) == 0)
    u = F.when(stuck, F.raise_error(F.concat("symbol", F.lit(" has no open to trade at"))).cast("double")).otherwise(F.col("_now.u"))
    return rows.select("candidate", "idx", "i", "symbol", "mark", "rate", "rebalance", "trades", "aim", "v", "v_before", F.col("_now.lot").alias("lot"), u.alias("u"), F.col("_old.lot").alias("old"), F.col("_old.u").alias("old_u"))


def chained(held: DataFrame, grid: DataFrame, rate: float, chunk: int) -> DataFrame:
    """(candidate, i, equity, tau): equity before trading, as a multiple of the first, and turnover of each rebalance.

    Equity grows by what lots gain, less ``rate`` times the turnover; turnover is the distance of the
    targets from the weights before, which depend on equity. A rebalance is clean if every name held
    trades: then weights are the targets whatever came before, and a wrong equity before it counts
    ``rate`` times the turnover behind it. So time is cut at clean rebalances into chunks that are folded
    apart, each from so many clean rebalances before its own that no trace of its start is left; the
    equity at its own beginning is then the product of the growth of the chunks before.
    """
    at = grid.where("idx = begin").select("candidate", "i", "idx")
    u = F.coalesce("old_u", F.lit(0.0))
    name = F.struct(F.col("old"), (u * F.col("mark")).alias("a"), (u * (F.col("v") - F.coalesce("v_before", "v"))).alias("x"), F.coalesce("aim", F.lit(0.0)).alias("t"), F.col("trades"))
    own = held.where("rebalance").groupBy("candidate", "i").agg(
        F.collect_list(name).alias("names"), F.bool_and(F.col("trades") | (u == 0)).alias("clean"), F.sum(F.abs(F.when(F.col("trades"), F.col("aim")))).alias("gross"),
    )
    steps = at.join(own, ["candidate", "i"], "left").withColumn("clean", F.coalesce("clean", F.lit(True)))
    steps = kept(steps.withColumn("place", F.sum(F.col("clean").cast("long")).over(Window.partitionBy("candidate").orderBy("i")) - 1), "steps")
    trace = 4.0 * rate * (steps.agg(F.max("gross")).first()[0] or 0.0)
    settle = 1 if trace <= 0 else math.ceil(math.log(SETTLED) / math.log(trace)) if trace < 0.5 else 1 << 40
    size = max(chunk, 2 * settle)
    c, inside = F.floor(F.col("place") / size), F.col("place") % size
    copies = F.array_compact(F.array(c, F.when(inside >= size - settle, c + 1), F.when((inside == 0) & F.col("clean") & (c > 0), c - 1)))
    spread = steps.select("candidate", "i", "names", c.alias("own"), F.explode(copies).alias("chunk"))
    listed = spread.groupBy("candidate", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "own", "names"))).alias("steps")).where(F.exists("steps", lambda e: e["own"] == F.col("chunk")))
    number = lambda x: x.cast("double")

    def step(s: Column, e: Column) -> Column:
        bought = lambda n, other: F.coalesce(F.get(s["equity"], (n["old"] - s["first"]).cast("int")), other)
        last = lambda name: F.get(s[name], F.size(s[name]) - 1)
        gain = F.aggregate(F.coalesce(e["names"], F.array()), F.lit(0.0), lambda sum_, n: number(sum_ + bought(n, F.lit(0.0)) * n["x"]))
        equity = F.when(F.size(s["equity"]) == 0, F.lit(1.0)).otherwise(last("equity") * (1.0 - rate * last("tau")) + gain)
        # The equity is bound to a variable, so that it is worked out once.
        made = F.transform(F.array(number(equity)), lambda q: F.struct(
            q.alias("q"), number(F.aggregate(F.filter(F.coalesce(e["names"], F.array()), lambda n: n["trades"]), F.lit(0.0), lambda sum_, n: number(sum_ + F.abs(n["t"] - bought(n, q) * n["a"] / q)))).alias("tau")))[0]
        return F.transform(F.array(made), lambda m: F.struct(s["first"].alias("first"), F.concat(s["equity"], F.array(m["q"])).alias("equity"), F.concat(s["tau"], F.array(m["tau"])).alias("tau")))[0]

    none = F.array().cast("array<double>")
    folded = listed.withColumn("f", F.aggregate("steps", F.struct(F.col("steps")[0]["i"].alias("first"), none.alias("equity"), none.alias("tau")), step))
    each = folded.select("candidate", "chunk", F.explode(F.arrays_zip(F.col("steps.i").alias("i"), F.col("steps.own").alias("own"), F.col("f.equity").alias("equity"), F.col("f.tau").alias("tau"))).alias("e")).select("candidate", "chunk", "e.*")
    first, after = F.min_by("equity", F.when(F.col("own") == F.col("chunk"), F.col("i"))), F.max(F.when(F.col("own") > F.col("chunk"), F.col("equity")))
    chunks = each.groupBy("candidate", "chunk").agg(first.alias("base"), after.alias("end"))
    before = F.product(F.col("end") / F.col("base")).over(Window.partitionBy("candidate").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("candidate", "chunk", (F.coalesce(before, F.lit(1.0)) / F.col("base")).alias("scale"))
    return each.where("own = chunk").join(chunks, ["candidate", "chunk"]).select("candidate", "i", (F.col("equity") * F.col("scale")).alias("equity"), "tau")


def entries(rows: DataFrame) -> DataFrame:
    """V9. ``entry_price``: the price at an opening or flip, blended on additions, kept on reductions; null when flat.

    Each trade is an affine map of the price before, so they are scanned (:func:`factors.affine`).
    """
    w = Window.partitionBy("candidate", "symbol").orderBy("idx")
    size, before = F.abs("weight"), F.abs("drifted")
    anew = F.col("trades") & (size >= 1e-15) & (F.col("weight") * F.col("drifted") <= 0)
    added = F.col("trades") & (size > before + 1e-15)
    rows = rows.withColumns({
        "_a": F.when(anew, 1.0).when(added, before / size), "_b": F.when(anew, F.col("mark")).when(added, F.col("mark") * F.abs("traded") / size), "_run": F.sum(anew.cast("long")).over(w),
    })
    return affine(rows, "_a", "_b", "entry_price", ("candidate", "symbol", "_run"), "idx").withColumn("entry_price", F.when(size >= 1e-15, F.col("entry_price"))).drop("_a", "_b", "_run")


def capped(rows: DataFrame, costs: Costs, initial: float) -> DataFrame:
    """:func:`fold` for a turnover limit: boundary after boundary, a candidate a group. The weights drift by
    d = w * (mark / mark before) / g; g = 1 - costs + returns + funding; trades are scaled to the limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        marks: dict[str, float] = {}
        entry: dict[str, float] = {}
        equity, base, out = initial, 1.0, []
        pdf = pdf.sort_values(["idx", "symbol"])
        name, at = pdf["candidate"].iloc[0], pdf["idx"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        symbols, opens, prices, targets, rebalance, rates = (pdf[c].tolist() for c in ("symbol", "open", "mark", "target", "rebalance", "rate"))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            here = [i for i in range(lo, hi) if isinstance(symbols[i], str)]
            now = {symbols[i]: prices[i] for i in here}
            moved = {s: w * (now.get(s, marks[s]) / marks[s]) for s, w in held.items()}
            growth = base + sum(moved[s] - w for s, w in held.items())
            equity *= growth
            drifted = {s: w / growth for s, w in moved.items()}
            held = dict(drifted)
            if any(rebalance[lo:hi]):
                for i in here:
                    s, target = symbols[i], targets[i]
                    if not math.isnan(opens[i]):
                        held[s] = 0.0 if math.isnan(target) else target
                    elif s not in drifted and target and not math.isnan(target):
                        raise ValueError(f"{s} has no open to trade at")
            delta = {s: held.get(s, 0.0) - drifted.get(s, 0.0) for s in {*held, *drifted}}
            total = sum(map(abs, delta.values()))
            if costs.max_turnover is not None and total > costs.max_turnover:
                k = costs.max_turnover / total
                delta = {s: d * k for s, d in delta.items()}
                held = {s: drifted.get(s, 0.0) + d for s, d in delta.items()}
                total = costs.max_turnover
            for s, d in delta.items():
                w0, w1, price = drifted.get(s, 0.0), held.get(s, 0.0), now.get(s, marks.get(s))
                if abs(w1) < 1e-15:
                    held.pop(s, None)
                    entry.pop(s, None)
                elif w0 * w1 <= 0:
                    entry[s] = price
                elif abs(w1) > abs(w0) + 1e-15:
                    entry[s] = (entry[s] * abs(w0) + price * abs(d)) / abs(w1)
            marks |= now
            rate = {symbols[i]: rates[i] for i in here if not math.isnan(rates[i])}
            funding = -sum(w * rate.get(s, 0.0) for s, w in held.items())
            base = 1.0 - costs.rate * total + funding
            for s in sorted({*held, *(s for s, d in delta.items() if d)}) or [None]:
                w = held.get(s, 0.0)
                out.append((name, int(at[lo]), s, w, w * equity / marks[s] if s else 0.0, entry.get(s), marks.get(s), equity, total, funding, delta.get(s, 0.0)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")]).astype({"symbol": object})

    return rows.groupBy("candidate").applyInPandas(run, FOLDED)


def boundary_rows(bars: DataFrame, targets: DataFrame, rebalances: DataFrame, cuts: DataFrame, funding: DataFrame | None, interval: str) -> DataFrame:
    """What :func:`fold` reads: each name at the boundaries of its holding spans, with marks carried forward.

    A span goes from a target to the candidate's next rebalance at which the name has an open.
    """
    at = cuts.select(F.col("open_time").alias("timestamp"), F.col("idx").cast("long").alias("idx"))
    opens = bars.where("is_complete").select(F.col("open_time").alias("timestamp"), "symbol", "open")
    t = targets.select("candidate", F.col("fill_time").alias("timestamp"), "symbol", F.col("target_weight").alias("target"))
    r = rebalances.select("candidate", F.col("fill_time").alias("timestamp")).distinct()
    trades = r.join(t.select("candidate", "symbol").distinct(), "candidate").join(opens, ["timestamp", "symbol"]).join(t, ["candidate", "timestamp", "symbol"], "left").join(at, "timestamp")
    w = Window.partitionBy("candidate", "symbol").orderBy("idx")
    spans = trades.withColumn("_to", F.lead("idx").over(w)).where("target is not null and target <> 0").crossJoin(at.agg(F.max("idx").alias("_last")))
    held = spans.select("candidate", "symbol", F.explode(F.sequence("idx", F.coalesce("_to", "_last"))).alias("idx"))
    named = t.join(at, "timestamp").select("candidate", "symbol", "idx")
    rows = held.union(named).distinct().join(at, "idx")
    marks = asof(rows.select("symbol", "timestamp").distinct(), bars.select("symbol", "close_time", "close"), "timestamp", "close_time", ["symbol"]).drop("close_time").join(opens, ["timestamp", "symbol"], "left")
    if funding is not None:
        step = seconds(interval) * 1000
        e = ms("funding_time") - 1
        rates = funding.groupBy(F.timestamp_millis(e - e % step).alias("timestamp"), "symbol").agg(F.sum("funding_rate").alias("rate"))
        marks = marks.join(rates, ["timestamp", "symbol"], "left")
    else:
        marks = marks.withColumn("rate", F.lit(None).cast("double"))
    marks = marks.select("symbol", "timestamp", "open", F.coalesce("open", "close").alias("mark"), "rate").where("mark is not null")
    full = rows.join(marks, ["symbol", "timestamp"]).join(t, ["candidate", "timestamp", "symbol"], "left").select("candidate", "idx", "timestamp", "symbol", "open", "mark", "target", "rate")
    null = F.lit(None).cast("double")
    alone = t.select("candidate").union(r.select("candidate")).distinct().crossJoin(at)  # candidates by boundaries: one row each
    alone = alone.select("candidate", "idx", "timestamp", F.lit(None).cast("string").alias("symbol"), null.alias("open"), null.alias("mark"), null.alias("target"), null.alias("rate"))
    out = full.unionByName(alone).join(r.withColumn("rebalance", F.lit(True)), ["candidate", "timestamp"], "left")
    return out.select("candidate", "idx", "symbol", "open", "mark", "target", F.coalesce("rebalance", F.lit(False)).alias("rebalance"), "rate")


def states(bars: DataFrame, targets: DataFrame, rebalances: DataFrame, interval: str, costs: Costs, initial: float, funding: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries, what :func:`fold` reads, and what it gives. The first two are small beside the market and read several times."""
    cuts = kept(boundaries(bars, rebalances, funding, interval), "boundaries")
    rows = kept(boundary_rows(bars, targets, rebalances, cuts, funding, interval), "boundary_rows")
    return cuts, rows, fold(rows, costs, initial)


def value(bars: DataFrame, targets: DataFrame, rebalances: DataFrame, interval: str, costs: Costs = Costs(), initial: float = 1e6, funding: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V4-V6, V10. (returns, positions) of all candidates at every bar of the market's clock.

    Marks are carried forward once for each (symbol, bar) that any candidate needs, then joined.
    """
    step = seconds(interval) * 1000
    cuts, rows, state = states(bars, targets, rebalances, interval, costs, initial, funding)
    clock = bars.select("open_time").distinct()
    spans = cuts.select("idx", F.explode(F.sequence(ms("open_time"), ms("next_time") - 1, F.lit(step))).alias("_t"), F.col("open_time").alias("boundary")).select("idx", F.timestamp_millis("_t").alias("open_time"), "boundary")
    spans = spans.join(clock, "open_time", "left_semi")
    needed = rows.where("symbol is not null").select("symbol", "idx").distinct().join(spans.select("idx", "open_time"), "idx").select("symbol", "open_time").distinct()
    marks = asof(needed, bars.select("symbol", F.col("open_time").alias("_at"), F.col("close").alias("mark_price")), "open_time", "_at", ["symbol"]).drop("_at")
    positions = state.join(spans, "idx").join(marks, ["symbol", "open_time"], "left")
    positions = positions.withColumns({"unrealized": F.col("weight") * F.col("equity") * (ratio(F.col("mark_price"), F.col("mark")) - 1.0), "notional": F.col("quantity") * F.col("mark_price")})
    held = F.col("symbol").isNotNull()
    totals = positions.groupBy("candidate", "open_time", "boundary").agg(
        F.first("equity").alias("base"), F.first("turnover").alias("turnover"), F.first("funding").alias("funding"),
        F.coalesce(F.sum(F.when(held, F.col("unrealized"))), F.lit(0.0)).alias("unrealized"),
        F.coalesce(F.sum(F.when(held, F.abs("notional"))), F.lit(0.0)).alias("gross_notional"), F.coalesce(F.sum(F.when(held, F.col("notional"))), F.lit(0.0)).alias("net_notional"),
    )
    return bar_returns(totals, costs, initial), positions.where(held & (F.col("weight") != 0))


def bar_returns(totals: DataFrame, costs: Costs, initial: float) -> DataFrame:
    """V5. Equity, returns, costs, drawdown and exposures of each bar."""
    w = Window.partitionBy("candidate").orderBy("open_time")
    first = F.col("open_time") == F.col("boundary")
    t = totals.withColumn("equity", F.col("base") * (1.0 - costs.rate * F.col("turnover") + F.col("funding")) + F.col("unrealized"))
    t = t.withColumns({"previous": F.coalesce(F.lag("equity").over(w), F.lit(initial)), "peak": F.greatest(F.max("equity").over(w), F.lit(initial))})
    share = lambda x: F.when(first, ratio(F.col("base") * x, F.col("previous"))).otherwise(0.0)
    t = t.withColumns({
        "net_return": ratio(F.col("equity"), F.col("previous")) - 1.0, "fee_cost": share(F.col("turnover") * costs.fee_bps / 1e4), "slippage_cost": share(F.col("turnover") * costs.slippage_bps / 1e4),
        "funding_return": share(F.col("funding")), "bar_turnover": share(F.col("turnover")), "drawdown": ratio(F.col("equity"), F.col("peak")) - 1.0,
        "gross_exposure": ratio(F.col("gross_notional"), F.col("equity")), "net_exposure": ratio(F.col("net_notional"), F.col("equity")),
    })
    return t.select(
        "candidate", F.col("open_time").alias("timestamp"), (F.col("net_return") + F.col("fee_cost") + F.col("slippage_cost") - F.col("funding_return")).alias("gross_price_return"),
        "fee_cost", "slippage_cost", "funding_return", "net_return", "equity", "drawdown", "gross_exposure", "net_exposure", F.col("bar_turnover").alias("turnover"),
    )


def cost_ledger(trades: DataFrame, funding: DataFrame) -> DataFrame:
    """V11. Return contributions by (candidate, timestamp, symbol): trade costs and funding together."""
    a = trades.select("candidate", "timestamp", "symbol", (-F.col("fee")).alias("fee"), (-F.col("slippage")).alias("slippage"), F.lit(0.0).alias("funding"))
    b = funding.select("candidate", "timestamp", "symbol", F.lit(0.0).alias("fee"), F.lit(0.0).alias("slippage"), F.col("cash").alias("funding"))
    return a.unionByName(b).groupBy("candidate", "timestamp", "symbol").agg(F.sum("fee").alias("fee"), F.sum("slippage").alias("slippage"), F.sum("funding").alias("funding"))


def leaderboard(returns: DataFrame, initial: float) -> DataFrame:
    """V12. Ending equity, total return, worst drawdown and number of trading bars by candidate."""
    return returns.groupBy("candidate").agg(F.max_by("equity", "timestamp").alias("ending_equity"), (F.max_by("equity", "timestamp") / initial - 1.0).alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.count_if(F.col("turnover") > 0).alias("trading_bars"))


def matrix_summary(returns: DataFrame) -> DataFrame:
    """V13. Compounded net and gross returns, costs, turnover and mean exposure by candidate.

    A bar that loses all compounds to -1, one that loses more to NaN.
    """
    # Spark's logarithm is null for what is lost whole or more, and a sum would leave that out: -inf and NaN stay in.
    log = lambda c: F.when(1.0 + F.col(c) > 0, F.log1p(c)).when(1.0 + F.col(c) == 0, float("-inf")).when(F.col(c).isNotNull(), float("nan"))
    compound = lambda c: F.exp(F.sum(log(c))) - 1.0
    return returns.groupBy("candidate").agg(
        compound("net_return").alias("net_return"), compound("gross_price_return").alias("gross_return"), F.sum("fee_cost").alias("fees"), F.sum("slippage_cost").alias("slippage"),
        F.sum("funding_return").alias("funding"), F.sum("turnover").alias("turnover"), F.avg("gross_exposure").alias("mean_gross"),
    )
