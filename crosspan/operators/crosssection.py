"""Cross-sectional transforms and rankings: all rows of one timestamp are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosspan.functions import ranks
from crosspan.functions.core import average_rank, is_finite, ratio


def at_time() -> WindowSpec:
    return Window.partitionBy("timestamp")


def replaced(df: DataFrame, value: Column, code: str) -> DataFrame:
    """Valid rows take ``value``; where it is null they become invalid with ``code``."""
    df = df.withColumn("_new", F.when(F.col("is_valid"), value).otherwise(F.col("value")))
    bad = F.col("is_valid") & F.col("_new").isNull()
    return df.withColumns({"value": F.col("_new"), "is_valid": F.col("is_valid") & ~bad, "invalid_reason": F.when(bad, code).otherwise(F.col("invalid_reason"))}).drop("_new")


def valid_value() -> Column:
    return F.when(F.col("is_valid"), F.col("value"))


def winsorize(df: DataFrame, lower: float, upper: float) -> DataFrame:
    """C1. Valid values drawn in to the nearest-rank quantiles of their time.

    The quantiles are found where the rank is theirs: no row holds more than its own value.
    """
    n = F.count(valid_value()).over(at_time())
    rank = F.row_number().over(at_time().orderBy(valid_value().asc_nulls_last()))
    df = df.withColumns({"_n": n, "_k": rank})
    for name, q in (("_lo", lower), ("_hi", upper)):
        df = df.withColumn(name, F.max(F.when(F.col("_k") == F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5) + 1, valid_value())).over(at_time()))
    return replaced(df, F.greatest(F.least("value", "_hi"), "_lo"), "INVALID_WINSORIZE").drop("_lo", "_hi", "_n", "_k")


def rank01(df: DataFrame, split: bool = False) -> DataFrame:
    """C2. Average ranks of valid values, scaled to 0..1; one row alone has 0.5.

    ``split``: several tasks share a time (:mod:`crosspan.functions.ranks`); for few times with very many rows.
    """
    if split:
        df = ranks.tied(df, ("timestamp", "is_valid"), "value").withColumn("_r", F.col("_rank") + (F.col("_ties") - 1) / 2.0)
        scaled = F.when(F.col("_size") == 1, 0.5).otherwise(ratio(F.col("_r") - 1.0, F.col("_size") - 1.0))
        return replaced(df, scaled, "INVALID_RANK").drop("_r", "_rank", "_ties", "_size")
    df = df.withColumn("_r", average_rank("value", "timestamp", "is_valid"))
    n = F.count(valid_value()).over(at_time())
    return replaced(df, F.when(n == 1, 0.5).otherwise(ratio(F.col("_r") - 1.0, n - 1.0)), "INVALID_RANK").drop("_r")


def zscore(df: DataFrame) -> DataFrame:
    """C3. Standard scores with the population deviation; without variance rows become invalid."""
    spread = F.stddev_pop(valid_value()).over(at_time())
    return replaced(df, F.when(spread > 0, ratio(F.col("value") - F.avg(valid_value()).over(at_time()), spread)), "ZERO_CROSS_SECTION_VARIANCE")


def robust_z(df: DataFrame, value: str = "value", limit: float = 3.0, key: str = "timestamp") -> DataFrame:
    """C4. Distance from the median in scaled median deviations, within +-limit; 0 where they are 0."""
    w = Window.partitionBy(key)
    df = df.withColumn("_c", F.median(value).over(w)).withColumn("_d", F.median(F.abs(F.col(value) - F.col("_c"))).over(w))
    z = F.when(F.col("_d") == 0, 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), ratio(F.col(value) - F.col("_c"), 1.4826 * F.col("_d")))))
    return df.withColumn("z", z).drop("_c", "_d")


def midrank(df: DataFrame, value: str = "value", key: str = "timestamp", out: str = "score") -> DataFrame:
    """C5. Average rank scaled to -0.5..0.5; times with one row are dropped."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).withColumn(out, ratio(average_rank(value, key) - 1.0, F.col("_n") - 1.0) - 0.5).where("_n > 1").drop("_n")


def competition_ranks(df: DataFrame, value: str = "value", key: str = "timestamp") -> DataFrame:
    """C6. One plus the number that is strictly better, from above and from below."""
    w = Window.partitionBy(key)
    return df.withColumns({"bullish": F.rank().over(w.orderBy(F.desc(value))), "bearish": F.rank().over(w.orderBy(value))})


def rank_snapshots(scores: DataFrame, factor_name: str, clock: str = "rebalance", split: bool = False) -> DataFrame:
    """C7. Ordinal rank (score descending, symbol ascending), percentile and count of each time; ``split`` as in :func:`rank01`."""
    good = scores.where(F.col("is_valid") & is_finite(F.col("value")))
    if split:
        good = ranks.placed(good, ("timestamp",), F.desc("value"), F.asc("symbol"), place="ordinal_rank", size="sample_count").withColumns({c: F.col(c).cast("int") for c in ("ordinal_rank", "sample_count")})
    else:
        good = good.withColumns({"sample_count": F.count("*").over(at_time()).cast("int"), "ordinal_rank": F.row_number().over(at_time().orderBy(F.desc("value"), "symbol"))})
    percentile = F.when(F.col("sample_count") == 1, 1.0).otherwise(1.0 - ratio(F.col("ordinal_rank") - 1.0, F.col("sample_count") - 1.0))
    return good.select("timestamp", F.lit(clock).alias("rank_clock"), "symbol", F.lit(factor_name).alias("factor_name"), F.col("value").alias("raw_score"), "ordinal_rank", percentile.alias("percentile_rank"), "sample_count", "factor_version", "universe_version")


def crop(snapshots: DataFrame, n: int) -> DataFrame:
    """C8. The first n ranks, for the published table."""
    return snapshots.where(F.col("ordinal_rank") <= n)


def ranked_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """C9. Ordinal rank by any order of columns."""
    return df.withColumn("ordinal_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
