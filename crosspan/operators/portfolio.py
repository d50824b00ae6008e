"""Selection, weighting and targets from ranked snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosspan.functions.core import is_finite, ms, ratio, seconds
from crosspan.functions.work import kept

def at_time() -> WindowSpec:
    return Window.partitionBy("timestamp")
DAY_MS = 86_400_000


def snapshot_index(times: DataFrame, column: str = "timestamp") -> DataFrame:
    """(timestamp, idx): snapshots numbered in time.

    Times are numbered within their day; only the days' counts, a row a day, are summed in one place.
    """
    t = times.select(F.col(column).alias("timestamp")).distinct().withColumn("_d", F.floor(ms("timestamp") / DAY_MS))
    days = t.groupBy("_d").agg(F.count("*").alias("_n"))
    before = days.withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_d")) - F.col("_n")).select("_d", "_b")
    own = t.withColumn("_i", F.row_number().over(Window.partitionBy("_d").orderBy("timestamp")))
    return own.join(before, "_d").select("timestamp", (F.col("_b") + F.col("_i") - 1).alias("idx"))


def long_short(scores: DataFrame, long: int | float, short: int | float, quantiles: bool = False) -> DataFrame:
    """P1, P2. Lowest scores SHORT, highest LONG, by count or share; times with too few rows drop out."""
    good = scores.where(F.col("is_valid") & is_finite(F.col("value"))).withColumns({"_n": F.count("*").over(at_time()), "_r": F.row_number().over(at_time().orderBy("value", "symbol"))})
    size = lambda q: F.greatest(F.lit(1), F.floor(F.col("_n") * q)) if quantiles else F.lit(q)
    good = good.withColumns({"_l": size(long), "_s": size(short)})
    kept = good.where((F.col("_n") >= 2) & (F.col("_l") + F.col("_s") <= F.col("_n")) & ((F.col("_r") <= F.col("_s")) | (F.col("_r") > F.col("_n") - F.col("_l"))))
    side = F.when(F.col("_r") <= F.col("_s"), "SHORT").otherwise("LONG")
    return kept.withColumns({"side": side, "score": F.col("value")}).drop("_n", "_r", "_l", "_s")


def in_ranges(rank: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | rank.between(a, b)
    return out


def exact_ranks(snapshots: DataFrame, long: list[tuple[int, int]], short: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """P3. Inclusive rank ranges by side, and the audit: what was selected, and requested ranks that
    no row has."""
    rank = F.col("ordinal_rank")
    side = F.when(in_ranges(rank, long), "LONG").when(in_ranges(rank, short), "SHORT")
    selected = snapshots.withColumn("side", side).where("side is not null").withColumn("score", F.col("raw_score"))
    asked = [(s, r) for s, spans in (("LONG", long), ("SHORT", short)) for a, b in spans for r in range(a, b + 1)]
    requests = snapshots.sparkSession.createDataFrame(asked, "side string, requested_rank int")
    samples = snapshots.select("timestamp", "sample_count").distinct()
    # The requests are the caller's short list.
    missing = samples.join(F.broadcast(requests), F.col("requested_rank") > F.col("sample_count")).select("timestamp", F.lit(None).cast("string").alias("symbol"), "side", "requested_rank", "sample_count", F.lit("RANK_OUT_OF_RANGE").alias("reason_code"))
    audit = selected.select("timestamp", "symbol", "side", rank.cast("int").alias("requested_rank"), "sample_count", F.lit("SELECTED_CURRENT_RANK").alias("reason_code"))
    return selected, audit.unionByName(missing)


def lagged_ranks(snapshots: DataFrame, lag: int, long: list[int], short: list[int]) -> DataFrame:
    """P4. At each snapshot the requested ranks of the one ``lag`` before, if still eligible, with reasons."""
    asked = [("LONG", r) for r in long] + [("SHORT", r) for r in short]
    requests = snapshots.sparkSession.createDataFrame(asked, "side string, requested_rank int")
    index = snapshot_index(snapshots)
    past = index.select(F.col("timestamp").alias("rank_source_time"), (F.col("idx") + lag).alias("idx"))
    wanted = index.join(past, "idx", "left").join(F.broadcast(requests))
    source = snapshots.select(F.col("timestamp").alias("rank_source_time"), F.col("ordinal_rank").cast("int").alias("requested_rank"), "symbol", F.col("raw_score").alias("score"))
    counts = snapshots.select(F.col("timestamp").alias("rank_source_time"), "sample_count").distinct()
    now = snapshots.select("timestamp", "symbol", F.lit(True).alias("_now"))
    j = wanted.join(counts, "rank_source_time", "left").join(source, ["rank_source_time", "requested_rank"], "left").join(now, ["timestamp", "symbol"], "left")
    why = F.when(F.col("rank_source_time").isNull(), "INSUFFICIENT_RANK_HISTORY").when(F.col("symbol").isNull(), "RANK_OUT_OF_RANGE").when(F.col("_now").isNull(), "HISTORICAL_RANK_NOT_CURRENTLY_ELIGIBLE").otherwise("SELECTED_HISTORICAL_RANK" if lag else "SELECTED_CURRENT_RANK")
    return j.select("timestamp", "rank_source_time", "symbol", "side", "requested_rank", "sample_count", "score", why.alias("reason_code"))


def adjacent(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ``_adj``: the symbol was in the snapshot just before."""
    w = Window.partitionBy("symbol").orderBy("idx")
    return snapshots.join(snapshot_index(snapshots), "timestamp").withColumn("_adj", F.coalesce(F.col("idx") - F.lag("idx").over(w) == 1, F.lit(False)))


def rank_descent(snapshots: DataFrame, start: int, entry: int, keep_equal: bool = True, decisions: DataFrame | None = None) -> DataFrame:
    """P5. In an unbroken run of falling ranks that began at ``start`` or beyond, the first row at
    ``entry`` (at a decision time). Absence breaks a run; equal ranks keep or break it."""
    w = Window.partitionBy("symbol").orderBy("idx")
    before = F.lag("ordinal_rank").over(w)
    worse = F.col("ordinal_rank") > before if keep_equal else F.col("ordinal_rank") >= before
    rows = adjacent(snapshots).withColumn("_new", (~F.col("_adj") | F.coalesce(worse, F.lit(True))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    inside = Window.partitionBy("symbol", "_island").orderBy("idx")
    rows = rows.withColumns({"_from": F.first("ordinal_rank").over(inside), "_pos": F.row_number().over(inside)})
    ok = (F.col("_from") >= start) & (F.col("_pos") > 1) & (F.col("ordinal_rank") == entry)
    if decisions is not None:
        rows = rows.join(decisions.select("timestamp", F.lit(True).alias("_dec")).distinct(), "timestamp", "left")
        ok = ok & F.coalesce("_dec", F.lit(False))
    hits = rows.where(ok).withColumn("_k", F.row_number().over(inside)).where("_k = 1")
    return hits.select("timestamp", "symbol", F.lit("LONG").alias("side"), "ordinal_rank", "raw_score", "sample_count")


def crossovers(scores: DataFrame, entry: float, exit_: float) -> DataFrame:
    """P6. LONG where a score rises above ``entry``, FLAT where it falls below ``exit_``, between
    adjacent snapshots."""
    good = scores.where(F.col("is_valid") & is_finite(F.col("value")))
    prior = F.lag("value").over(Window.partitionBy("symbol").orderBy("idx"))
    rows = adjacent(good).withColumn("_p", F.when(F.col("_adj"), prior))
    side = F.when((F.col("_p") <= entry) & (F.col("value") > entry), "LONG").when((F.col("_p") >= exit_) & (F.col("value") < exit_), "FLAT")
    return rows.withColumn("side", side).where("side is not null").select("timestamp", "symbol", F.col("value").alias("score"), "side")


def weights(selected: DataFrame, how: str = "equal", gross: float = 1.0, net: float = 0.0) -> DataFrame:
    """P7. Weights by side: equal, by |score|, or by inverse volatility, within the side's budget."""
    strength = {"equal": F.lit(1.0), "score": F.abs("score")}.get(how)
    if strength is None:
        v = F.col("volatility")
        strength = F.when(is_finite(v) & (v > 0), ratio(F.lit(1.0), v)).otherwise(0.0)
    w = Window.partitionBy("timestamp", "side")
    s = selected.withColumn("_s", strength).withColumns({"_t": F.sum("_s").over(w), "_n": F.count("*").over(w)})
    share = F.when(F.col("_t") > 0, ratio(F.col("_s"), F.col("_t"))).otherwise(ratio(F.lit(1.0), F.col("_n")))
    weight = F.when(F.col("side") == "LONG", share * (gross + net) / 2.0).otherwise(-share * (gross - net) / 2.0)
    return s.withColumn("unconstrained_weight", weight).drop("_s", "_t", "_n")


def capped(weighted: DataFrame, limit: float) -> DataFrame:
    """P8. Weights within +-limit, with a flag; nothing is dealt out anew."""
    w = F.col("unconstrained_weight")
    return weighted.withColumns({"target_weight": F.greatest(F.lit(-limit), F.least(F.lit(limit), w)), "constraint_flags": F.when(F.abs(w) > limit, "MAX_SYMBOL_WEIGHT").otherwise("")})


def water_filling(side: DataFrame, cap: float = 0.05, budget: float = 0.5, floor: float = 0.001) -> DataFrame:
    """P9. Inverse-volatility weights under a cap: the first prefix of the sorted strengths whose rest
    fits under it.

    The rest is summed up from the weakest: a frame that ends with the window is added up anew for each row.
    """
    w = Window.partitionBy("timestamp")
    o = w.orderBy("_s", F.desc("symbol"))
    s = side.withColumn("_s", 1.0 / F.greatest("volatility", F.lit(floor))).withColumns({"_i": F.count("*").over(w) - F.row_number().over(o), "_rest": F.sum("_s").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    left = F.greatest(F.lit(0.0), budget - cap * F.col("_i"))
    s = s.withColumn("_fits", ratio(left * F.col("_s"), F.col("_rest")) <= cap)
    first = F.min(F.struct(F.when(F.col("_fits"), F.col("_i")).otherwise(1 << 30).alias("i"), F.col("_rest").alias("rest"))).over(w)
    s = s.withColumns({"_m": first["i"], "_r": first["rest"]})
    weight = F.when(F.col("_i") < F.col("_m"), cap).otherwise(ratio(F.greatest(F.lit(0.0), budget - cap * F.col("_m")) * F.col("_s"), F.col("_r")))
    return s.withColumn("weight", weight).drop("_s", "_i", "_rest", "_fits", "_m", "_r")


ROUNDS = 4


def follow(near: Column, book: Column, count: int) -> Column:
    """The rows of a snapshot (in order of rank) that are held after it, if ``book`` was held before."""
    stay = F.slice(F.filter(near, lambda r: F.array_contains(book, r["symbol"])), 1, count)
    top = F.filter(near, lambda r: (r["ordinal_rank"] <= count) & ~F.array_contains(book, r["symbol"]))
    return F.concat(stay, F.slice(top, F.lit(1), F.lit(count) - F.size(stay)))


def end_of(snaps: Column, start: Column, count: int) -> Column:
    """The symbols held after a chunk's snapshots, in order of the alphabet."""
    return F.sort_array(F.aggregate(snaps, start, lambda book, s: F.transform(follow(s["near"], book, count), lambda r: r["symbol"])))


def books_of(snaps: Column, start: Column, count: int) -> Column:
    """What is held after each snapshot of a chunk: (timestamp, rows, the symbols held before)."""
    kind = "struct<book:array<string>,out:array<struct<timestamp:timestamp,rows:array<struct<ordinal_rank:int,symbol:string>>,before:array<string>>>>"

    def step(acc: Column, s: Column) -> Column:
        rows = follow(s["near"], acc["book"], count)
        one = F.struct(s["timestamp"].alias("timestamp"), rows.alias("rows"), acc["book"].alias("before"))
        return F.struct(F.transform(rows, lambda r: r["symbol"]).alias("book"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    return F.aggregate(snaps, F.struct(start.alias("book"), F.array().alias("out")).cast(kind), step, lambda acc: acc["out"])


def in_order(chunks: DataFrame, strategy: str, count: int) -> DataFrame:
    """(strategy, chunk, start) by following each strategy's chunks one after another: rows stream through
    a task in order, which holds a single book. ``want`` of the first chunk is where it starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, held = None, []
        for pdf in batches:
            out = []
            for name, chunk, snaps, want in zip(pdf[strategy], pdf["chunk"], pdf["snaps"], pdf["want"], strict=True):
                if name != mine:
                    mine, held = name, list(want)
                out.append((name, chunk, sorted(held)))
                for s in snaps:
                    near = [(r["ordinal_rank"], r["symbol"]) for r in s["near"]]
                    before = set(held)
                    stay = [x for _, x in near if x in before][:count]
                    held = stay + [x for r, x in near if r <= count and x not in before][: count - len(stay)]
            yield pd.DataFrame(out, columns=[strategy, "chunk", "start"])

    rows = chunks.repartition(strategy).sortWithinPartitions(strategy, "chunk").select(strategy, "chunk", "snaps", "want")
    return rows.mapInPandas(run, f"{strategy} {rows.schema[strategy].dataType.simpleString()}, chunk long, start array<string>")


def hysteresis(ranked: DataFrame, count: int, keep: int, strategy: str = "strategy", every: str = "64d", rounds: int = ROUNDS) -> DataFrame:
    """P10. Hold names while they stay within rank ``keep``, fill up from the top to ``count``.

    What is held depends on the time before, but seldom on much of it. So time is cut into chunks of
    ``every`` which are followed at the same time, each from an empty book; where the book at the end of
    a chunk isn't the one that the next began with, that one is followed again from it. Seams are compared
    as rows of at most ``count`` names a chunk. A strategy with seams that don't meet after ``rounds``
    times is followed in order from the first such seam on, with one book in memory. A task holds a
    chunk's snapshots, and of these ranks within ``keep`` alone. No rows give none.
    """
    span = seconds(every) * 1000
    rows = ranked.where(F.col("ordinal_rank") <= keep).select(strategy, "timestamp", "symbol", F.col("ordinal_rank").cast("int").alias("ordinal_rank"))
    snaps = rows.groupBy(strategy, "timestamp").agg(F.sort_array(F.collect_list(F.struct("ordinal_rank", "symbol"))).alias("near"))
    chunked = snaps.groupBy(strategy, F.floor(ms("timestamp") / span).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("timestamp", "near"))).alias("snaps"))
    chunks = kept(chunked, "chunks")
    empty = F.array().cast("array<string>")
    began = lambda df, start: df.select(strategy, "chunk", start.alias("start"), end_of(F.col("snaps"), start, count).alias("end"))
    seams = kept(began(chunks, empty), "seams")
    w = Window.partitionBy(strategy).orderBy("chunk")
    for n in range(rounds + 1):
        seams = seams.withColumn("want", F.coalesce(F.lag("end").over(w), empty))
        apart = seams.where("start != want")
        if apart.isEmpty():
            break
        if n < rounds:
            again = began(chunks.join(apart.select(strategy, "chunk", "want"), [strategy, "chunk"]), F.col("want"))
            seams = kept(seams.where("start = want").drop("want").unionByName(again), "seams")
        else:
            first = apart.groupBy(strategy).agg(F.min("chunk").alias("_from"))
            tails = seams.join(first, strategy).where("chunk >= _from").select(strategy, "chunk", "want")
            tails = in_order(chunks.join(tails, [strategy, "chunk"]), strategy, count)
            before = seams.join(first, strategy, "left").where("_from is null or chunk < _from")
            seams = before.select(strategy, "chunk", "start").unionByName(tails)
    books = chunks.join(seams.select(strategy, "chunk", "start"), [strategy, "chunk"]).select(strategy, F.explode(books_of(F.col("snaps"), F.col("start"), count)).alias("b"))
    held = books.select(strategy, "b.timestamp", F.explode("b.rows").alias("r"), F.col("b.before").alias("_before"))
    return held.select(strategy, "timestamp", "r.symbol", "r.ordinal_rank", F.array_contains("_before", F.col("r.symbol")).alias("kept"))


def schedule_faults(targets: DataFrame, rebalances: DataFrame) -> DataFrame:
    """P11. One row: repeated keys, fills not after their signal, weights not finite, undeclared times."""
    declared = rebalances.select(F.col("fill_time"), F.lit(1).alias("_d")).distinct()
    keyed = targets.groupBy("fill_time", "symbol").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"))
    rest = targets.join(declared, "fill_time", "left").agg(
        F.count_if(F.col("fill_time") <= F.col("signal_time")).alias("fill_not_after_signal"), F.count_if(~is_finite(F.col("target_weight"))).alias("non_finite_weights"), F.count_if(F.col("_d").isNull()).alias("undeclared_times")
    )
    return keyed.crossJoin(rest)  # one row by one row


def symbols_to_zero(targets: DataFrame, funding: DataFrame) -> DataFrame:
    """P12. Symbols that some funding time lacks, under the policy that excludes them."""
    total = funding.agg(F.count_distinct("funding_time").alias("_all"))
    have = funding.groupBy("symbol").agg(F.count_distinct("funding_time").alias("events"))
    j = targets.select("symbol").distinct().join(have, "symbol", "left").crossJoin(total)
    return j.select("symbol", F.coalesce("events", F.lit(0)).alias("events"), (F.coalesce("events", F.lit(0)) < F.col("_all")).alias("zeroed"))


def sized(orders: DataFrame, how: str, amount: float, leverage: float = 1.0, step: float = 0.001) -> DataFrame:
    """P13. Quantity by fixed margin, fixed notional or share of ``equity``, drawn toward zero to a step."""
    notional = {"margin": F.lit(amount * leverage), "notional": F.lit(amount), "equity": F.col("equity") * amount}[how]
    signed = notional * F.when(F.col("side") == "SHORT", -1.0).otherwise(1.0)
    q = ratio(signed, F.col("price"))
    return orders.withColumns({"notional": signed, "quantity": F.floor(F.abs(q) / step + 1e-10) * step * F.signum(q)})
