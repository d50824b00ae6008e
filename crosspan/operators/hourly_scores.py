"""Scores on hourly closes and funding at decision times (family L).

``hours``: symbol, at (the hour's end), close. ``decisions``: timestamp. Offsets are exact times; an
hour that is missing gives no value. Every history join unfolds an hour to the few decisions that
look back on it, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions import rolling
from crosspan.functions.core import ms, ratio
from crosspan.functions.rolling import Windows
from crosspan.operators.crosssection import midrank, robust_z
from crosspan.operators.timeaxis import asof

H = 3_600_000


def keyed(hours: DataFrame) -> DataFrame:
    return hours.where("close > 0").select("symbol", ms("at").alias("t"), "close")


def shifted(h: DataFrame, by: int, name: str) -> DataFrame:
    """The close ``by`` hours before each time."""
    return h.select("symbol", (F.col("t") + by * H).alias("t"), F.col("close").alias(name))


def with_returns(h: DataFrame) -> DataFrame:
    """``r``: log return of exactly one hour; ``g``: of the hours since the close before, per root hour."""
    w = Window.partitionBy("symbol").orderBy("t")
    gap = (F.col("t") - F.lag("t").over(w)) / H
    change = F.log(F.col("close") / F.lag("close").over(w))
    return h.withColumns({"r": F.when(gap == 1, change), "g": change / F.sqrt(gap)})


def at_decisions(h: DataFrame, decisions: DataFrame) -> DataFrame:
    return h.join(decisions.select(ms("timestamp").alias("t")).distinct(), "t", "left_semi")


def buffered_momentum(hours: DataFrame, decisions: DataFrame, long: int = 696, skip: int = 24, vol: int = 168, floor: float = 0.002) -> DataFrame:
    """L1. log(p_skip / p_long) over root time and the hourly deviation, which needs every hour."""
    w = Windows(("symbol",), "t")
    deviation, first = w.std(F.col("r"), vol), w.lag(F.col("t"), vol - 1)
    h = w.added(with_returns(keyed(hours))).withColumn("_s", F.when(F.col("t") - first == (vol - 1) * H, deviation))
    j = at_decisions(h.select("symbol", "t", "_s"), decisions).join(shifted(keyed(hours), long, "_old"), ["symbol", "t"]).join(shifted(keyed(hours), skip, "_skip"), ["symbol", "t"]).where("_s is not null")
    return j.select("symbol", "t", (F.log(F.col("_skip") / F.col("_old")) / (float(long - skip) ** 0.5 * F.greatest("_s", F.lit(floor)))).alias("score"))


def blend(hours: DataFrame, funding: DataFrame, decisions: DataFrame, far: int = 96, near: int = 24, least: int = 60) -> DataFrame:
    """L2. 0.40 carry, 0.35 momentum and 0.25 reversal, each as a robust z."""
    w = Window.partitionBy("symbol").orderBy("funding_time").rowsBetween(-2, 0)
    last3 = funding.select("symbol", "funding_time", F.when(F.count("funding_rate").over(w) == 3, -F.avg("funding_rate").over(w)).alias("carry"))
    h = with_returns(keyed(hours))
    now, g = at_decisions(h.select("symbol", "t", "close"), decisions), F.col("g")
    past = rolling.at_times(h.select("symbol", "t", "g"), now.select("symbol", (F.col("t") - near * H).alias("t")), (far - 1 - near) * H + 1, {"_n": rolling.counted(g), "_s": rolling.deviation(g, 1)})
    j = now.join(past.withColumn("t", F.col("t") + near * H), ["symbol", "t"]).join(shifted(keyed(hours), far, "_far"), ["symbol", "t"]).join(shifted(keyed(hours), near, "_near"), ["symbol", "t"]).where((F.col("_n") >= least) & (F.col("_s") > 0))
    j = j.select("symbol", "t", F.timestamp_millis("t").alias("timestamp"), (F.log(F.col("_near") / F.col("_far")) / F.col("_s")).alias("momentum"), (-F.log(F.col("close") / F.col("_near"))).alias("reversal"))
    j = asof(j, last3, "timestamp", "funding_time", ["symbol"]).where("carry is not null")
    total: Column = F.lit(0.0)
    for name, weight in (("carry", 0.40), ("momentum", 0.35), ("reversal", 0.25)):
        j = robust_z(j, name, key="t").withColumnRenamed("z", f"z_{name}")
        total = total + weight * F.col(f"z_{name}")
    return j.select("symbol", "t", total.alias("score"))


def looked_back(h: DataFrame, decisions: DataFrame, window: int, every: int = 24) -> DataFrame:
    """Each hour once for every decision at most ``window`` - 1 hours later; ``t`` is the decision, ``lag`` hours."""
    first = F.ceil(F.col("at") / (every * H)).cast("long") * (every * H)
    spread = h.withColumnRenamed("t", "at").withColumn("t", F.explode(F.sequence(first, first + F.lit((window // every) * every * H), F.lit(every * H))))
    spread = spread.withColumn("lag", ((F.col("t") - F.col("at")) / H).cast("int")).where(F.col("lag") < window)
    return spread.join(decisions.select(ms("timestamp").alias("t")).distinct(), "t", "left_semi")


def funding_sums(funding: DataFrame, decisions: DataFrame, window: int) -> DataFrame:
    """(symbol, t, carry, n): settlements in [t - window hours, t) of decisions a day apart."""
    f = funding.select("symbol", ms("funding_time").alias("f"), "funding_rate")
    first = (F.floor(F.col("f") / (24 * H)) + 1).cast("long") * (24 * H)
    f = f.withColumn("t", F.explode(F.sequence(first, first + F.lit((window // 24) * 24 * H), F.lit(24 * H)))).where(F.col("f") >= F.col("t") - window * H)
    f = f.join(decisions.select(ms("timestamp").alias("t")).distinct(), "t", "left_semi")
    return f.groupBy("symbol", "t").agg((-F.sum("funding_rate")).alias("carry"), F.count("funding_rate").alias("n"))


def residual(hours: DataFrame, funding: DataFrame, decisions: DataFrame, eligible: DataFrame | None = None, window: int = 168, skip: int = 24, names: int = 30, least_momentum: int = 115, least_all: int = 134, least_funding: int = 18) -> DataFrame:
    """L3. Residual momentum against each hour's median over the names eligible *now*, and funding
    carry; the mean of the two mid-ranks."""
    r = looked_back(with_returns(keyed(hours)).where("r is not null"), decisions, window)
    if eligible is not None:
        r = r.join(eligible.select("symbol", ms("timestamp").alias("t")).distinct(), ["symbol", "t"], "left_semi")
    w = Window.partitionBy("t", "lag")
    r = r.withColumns({"_m": F.median("r").over(w), "_k": F.count("*").over(w)}).where(F.col("_k") >= names).withColumn("e", F.col("r") - F.col("_m"))
    late = F.when(F.col("lag") >= skip, F.col("e"))
    s = r.groupBy("symbol", "t").agg(F.sum(late).alias("_sum"), F.count(late).alias("_n"), F.count("e").alias("_all"), F.stddev_samp("e").alias("_s"))
    s = s.where((F.col("_n") >= least_momentum) & (F.col("_all") >= least_all) & (F.col("_s") >= 1e-8)).withColumn("momentum", F.col("_sum") / F.col("_s"))
    j = s.join(funding_sums(funding, decisions, window).where(F.col("n") >= least_funding), ["symbol", "t"])
    j = midrank(midrank(j, "momentum", "t", "a"), "carry", "t", "b")
    return j.select("symbol", "t", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("score"))


def carry_and_excess(hours: DataFrame, funding: DataFrame, decisions: DataFrame, window: int = 168, least: int = 120, carry_hours: int = 72, names: int = 10) -> DataFrame:
    """L4. Funding carry of ``carry_hours``, root mean square return, and 24-hour excess over the median."""
    r = looked_back(with_returns(keyed(hours)).where("r is not null"), decisions, window)
    s = r.groupBy("symbol", "t").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.count("r").alias("_n")).where(F.col("_n") >= least)
    c = funding_sums(funding, decisions, carry_hours).where("n >= 3").select("symbol", "t", "carry")
    j = s.join(c, ["symbol", "t"]).join(keyed(hours), ["symbol", "t"], "left").join(shifted(keyed(hours), 24, "_day"), ["symbol", "t"], "left")
    j = j.withColumn("_r", F.log(ratio(F.col("close"), F.col("_day"))))
    w = Window.partitionBy("t")
    excess = F.when(F.count("_r").over(w) >= names, F.col("_r") - F.median("_r").over(w))
    return j.select("symbol", "t", F.col("carry").alias("score"), "rms", excess.alias("excess_24h"))
