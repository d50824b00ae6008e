"""Performance, risk and integrity of return ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions.core import is_finite, ratio, seconds

YEAR_SECONDS = 365.25 * 86400


def performance(returns: DataFrame, interval: str, key: str = "candidate") -> DataFrame:
    """M1. Total and annualised return, volatility, Sharpe, Sortino, worst drawdown with the initial
    equity, Calmar, share of gains."""
    w = Window.partitionBy(key).orderBy("timestamp")
    a = YEAR_SECONDS / seconds(interval)
    r = returns.withColumn("_i", F.first(ratio(F.col("equity"), 1.0 + F.col("net_return"))).over(w)).withColumn("_dd", ratio(F.col("equity"), F.greatest(F.max("equity").over(w), F.col("_i"))) - 1.0)
    s = r.groupBy(key).agg(
        F.count("*").alias("observations"), (F.max_by("equity", "timestamp") / F.min_by("_i", "timestamp") - 1.0).alias("total_return"), F.avg("net_return").alias("_m"), F.coalesce(F.stddev_pop("net_return"), F.lit(0.0)).alias("_s"),
        F.sqrt(F.avg(F.when(F.col("net_return") < 0, F.col("net_return") ** 2).otherwise(0.0))).alias("_d"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"),
    )
    s = s.withColumn("annualized_return", F.pow(1.0 + F.col("total_return"), F.lit(a) / F.col("observations")) - 1.0)
    return s.select(
        key, "observations", "total_return", "annualized_return", (F.col("_s") * a**0.5).alias("volatility"), (ratio(F.col("_m"), F.col("_s")) * a**0.5).alias("sharpe"), (ratio(F.col("_m"), F.col("_d")) * a**0.5).alias("sortino"),
        "max_drawdown", ratio(F.col("annualized_return"), -F.col("max_drawdown")).alias("calmar"), "hit_rate",
    )


def integrity(returns: DataFrame, key: str = "candidate", tolerance: float = 1e-10) -> DataFrame:
    """M2. Flags of a ledger that can't be trusted."""
    w = Window.partitionBy(key).orderBy("timestamp")
    before, t, n, e = F.lag("equity").over(w), F.lag("timestamp").over(w), F.col("net_return"), F.col("equity")
    r = returns.withColumns({"_same": F.col("timestamp") == t, "_made": F.coalesce(before, ratio(e, 1.0 + n)) * (1.0 + n)})
    off = F.abs(F.col("_made") - e) > tolerance * F.greatest(F.lit(1.0), F.abs("_made"), F.abs(e))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return r.groupBy(key).agg(flag(F.col("_same")).alias("duplicate_timestamp"), flag(F.col("timestamp").isNull()).alias("null_timestamp"), flag(~is_finite(n)).alias("bad_return"), flag(n <= -1).alias("return_below_floor"), flag(e <= 0).alias("nonpositive_equity"), flag(off).alias("compound_mismatch"))


def risk(returns: DataFrame, key: str = "candidate") -> DataFrame:
    """M3. Mean and largest gross and net exposure, and turnover."""
    return returns.groupBy(key).agg(
        F.avg("gross_exposure").alias("mean_gross"), F.max("gross_exposure").alias("max_gross"), F.avg(F.abs("net_exposure")).alias("mean_net"), F.max(F.abs("net_exposure")).alias("max_net"),
        F.avg("turnover").alias("mean_turnover"), F.max("turnover").alias("max_turnover"), F.sum("turnover").alias("total_turnover"),
    )


def attribution(returns: DataFrame, key: str = "candidate") -> DataFrame:
    """M4. Sums of the return's parts, and the largest error of their identity."""
    error = F.abs(F.col("gross_price_return") - F.col("fee_cost") - F.col("slippage_cost") + F.col("funding_return") - F.col("net_return"))
    return returns.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("gross_price_return", "fee_cost", "slippage_cost", "funding_return", "net_return")), F.max(error).alias("identity_error"))


def trade_stats(trades: DataFrame, key: str = "candidate") -> DataFrame:
    """M5. Number, buys, sells, symbols, first and last time, notional."""
    d = F.col("delta_notional")
    return trades.groupBy(key).agg(F.count("*").alias("trades"), F.count_if(d > 0).alias("buys"), F.count_if(d < 0).alias("sells"), F.count_distinct("symbol").alias("symbols"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum(F.abs(d)).alias("notional"))


def series_sample(returns: DataFrame, n: int, key: str = "candidate") -> DataFrame:
    """M6. About n evenly spaced rows of each series, its last row and the row of the worst drawdown."""
    w = Window.partitionBy(key)
    r = returns.withColumns({"_i": F.row_number().over(w.orderBy("timestamp")) - 1, "_n": F.count("*").over(w), "_worst": F.min(F.struct("drawdown", "timestamp")).over(w)["timestamp"]})
    even = F.floor(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1))) != F.floor((F.col("_i") - 1) * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return r.where(even | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("timestamp") == F.col("_worst"))).drop("_i", "_n", "_worst")


def first_difference(left: DataFrame, right: DataFrame, fields: list[str], key: str = "timestamp", tolerance: float = 1e-9) -> DataFrame:
    """M7 (J7). The first (time, field) at which two tables differ by more than the tolerance, or miss a row."""
    a = left.select(F.col(key).alias("_a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = right.select(F.col(key).alias("_b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer").withColumn(key, F.coalesce("_a", "_b"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("double").alias("left"), F.col(f"b_{f}").cast("double").alias("right")) for f in fields)))
    rows = j.select(key, pairs.alias("p")).select(key, "p.*")
    return rows.where(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance)).orderBy(key, "field").limit(1)
