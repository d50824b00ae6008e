"""Labels and research diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions import ranks
from crosspan.functions.core import average_rank, bars_in, by_symbol, correlation, is_finite, ms, ratio, seconds


def forward_returns(bars: DataFrame, universe: DataFrame, interval: str, horizon: str, delay: int = 1, entry: str = "open", exit_: str = "open", name: str = "forward", version: str = "v1") -> DataFrame:
    """D1. Return from ``delay`` bars after the signal over ``horizon``, at its exact times, with reasons."""
    w, step, n = by_symbol(), seconds(interval) * 1000, bars_in(horizon, interval)
    out = delay + n
    ahead = lambda c, k: F.lead(c, k).over(w)
    time = {"open": "open_time", "close": "close_time"}
    candidates = bars.select(
        F.col("close_time").alias("timestamp"), "symbol", ahead(entry, delay).alias("entry_price"), ahead(exit_, out).alias("exit_price"),
        ahead(time[entry], delay).alias("entry_time"), ahead(time[exit_], out).alias("exit_time"),
        ((ms(ahead("open_time", delay)) - ms("close_time") == (delay - 1) * step) & (ms(ahead("open_time", out)) - ms("close_time") == (out - 1) * step)).alias("_adjacent"),
        (F.coalesce(ahead("is_complete", delay), F.lit(False)) & F.coalesce(ahead("is_complete", out), F.lit(False))).alias("_whole"),
    )
    joined = universe.where("is_eligible").select("timestamp", "symbol").join(candidates, ["timestamp", "symbol"], "left")
    price_ok = is_finite(F.col("entry_price")) & is_finite(F.col("exit_price")) & (F.col("entry_price") > 0) & (F.col("exit_price") > 0)
    why = (
        F.when(F.col("entry_time").isNull() | F.col("exit_time").isNull(), "INSUFFICIENT_FUTURE").when(~F.coalesce("_adjacent", F.lit(False)), "GAPPED_FUTURE")
        .when(~F.coalesce("_whole", F.lit(False)), "INCOMPLETE_PRICE_BAR").when(~F.coalesce(price_ok, F.lit(False)), "INVALID_PRICE")
    )
    return joined.withColumn("invalid_reason", why).select(
        "timestamp", "symbol", F.lit(name).alias("label_name"), F.lit(version).alias("label_version"), "entry_time", "exit_time", "entry_price", "exit_price",
        F.when(F.col("invalid_reason").isNull(), ratio(F.col("exit_price"), F.col("entry_price")) - 1.0).alias("forward_return"), F.col("invalid_reason").isNull().alias("is_valid"), "invalid_reason",
    )


def aligned(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """J1. Valid factor values with valid labels."""
    return factors.where("is_valid").select("timestamp", "symbol", "value").join(labels.where("is_valid").select("timestamp", "symbol", "forward_return"), ["timestamp", "symbol"])


def information_coefficient(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """D2. Pearson and rank correlation of value and forward return by time, with the count."""
    ranked = aligned(factors, labels).withColumns({"_x": average_rank("value", "timestamp"), "_y": average_rank("forward_return", "timestamp")})
    return ranked.groupBy("timestamp").agg(F.count("*").alias("sample_count"), correlation(F.col("value"), F.col("forward_return")).alias("ic"), correlation(F.col("_x"), F.col("_y")).alias("rank_ic"))


def quantile_returns(factors: DataFrame, labels: DataFrame, quantiles: int = 5, split: bool = False) -> DataFrame:
    """D3. Mean forward return by bucket floor((ordinal - 1) q / n) + 1 of the factor's order; ``split``: several tasks share a time."""
    if split:
        placed = ranks.placed(aligned(factors, labels), ("timestamp",), F.asc("value"), F.asc("symbol"), place="_r", size="_n")
    else:
        w = Window.partitionBy("timestamp")
        placed = aligned(factors, labels).withColumns({"_r": F.row_number().over(w.orderBy("value", "symbol")), "_n": F.count("*").over(w)})
    bucket = F.floor((F.col("_r") - 1) * quantiles / F.col("_n")) + 1
    return placed.groupBy("timestamp", bucket.cast("long").alias("quantile")).agg(F.count("*").alias("sample_count"), F.avg("forward_return").alias("mean_forward_return"))


def coverage(factors: DataFrame, labels: DataFrame, universe: DataFrame) -> DataFrame:
    """D4. By time: eligible rows, those with factor and label, and the valid ones."""
    eligible = universe.where("is_eligible").select("timestamp", "symbol").distinct()
    f = factors.select("timestamp", "symbol", F.lit(1).alias("_f"), F.col("is_valid").cast("int").alias("_fv"))
    lab = labels.select("timestamp", "symbol", F.lit(1).alias("_l"), F.col("is_valid").cast("int").alias("_lv"))
    j = eligible.join(f, ["timestamp", "symbol"], "left").join(lab, ["timestamp", "symbol"], "left").na.fill(0, ["_f", "_fv", "_l", "_lv"])
    return j.groupBy("timestamp").agg(
        F.count("*").alias("eligible_count"), F.sum("_f").alias("factor_count"), F.sum("_fv").alias("valid_factor_count"), F.sum("_l").alias("label_count"),
        F.sum("_lv").alias("valid_label_count"), F.sum(F.col("_fv") * F.col("_lv")).alias("aligned_valid_count"),
    )


def rank_turnover(factors: DataFrame) -> DataFrame:
    """D5. Mean absolute change of the scaled rank against the symbol's previous observation."""
    n = F.count("*").over(Window.partitionBy("timestamp"))
    ranked = factors.where("is_valid").withColumns({"_n": n, "_a": average_rank("value", "timestamp")})
    ranked = ranked.withColumn("_r", F.when(F.col("_n") == 1, 0.5).otherwise(ratio(F.col("_a") - 1, F.col("_n") - 1.0)))
    moved = ranked.withColumn("_d", F.abs(F.col("_r") - F.lag("_r").over(Window.partitionBy("symbol").orderBy("timestamp"))))
    return moved.groupBy("timestamp").agg(F.count("_d").alias("sample_count"), F.avg("_d").alias("rank_turnover"))


def evaluate(factors: DataFrame, labels: DataFrame, universe: DataFrame, quantiles: int = 5) -> dict[str, DataFrame]:
    """D6. Coefficients, quantile returns, coverage and turnover of one factor."""
    return {
        "ic": information_coefficient(factors, labels), "quantiles": quantile_returns(factors, labels, quantiles),
        "coverage": coverage(factors, labels, universe), "turnover": rank_turnover(factors),
    }


def predictive_summary(ic: DataFrame, quantile: DataFrame, top: int = 5) -> DataFrame:
    """D7. Count, mean and ratio of the rank coefficient, share above 0 (by more than rounding), and top less bottom return."""
    a = ic.where(is_finite(F.col("rank_ic"))).agg(
        F.count("*").alias("observations"), F.avg("rank_ic").alias("mean_rank_ic"), ratio(F.avg("rank_ic"), F.stddev_pop("rank_ic")).alias("rank_ic_ir"),
        F.avg((F.col("rank_ic") > 1e-12).cast("double")).alias("positive_share"), F.avg("sample_count").alias("mean_sample"),
    )
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_forward_return")))
    spread = quantile.groupBy("timestamp").agg((at(top) - at(1)).alias("s")).agg(F.avg("s").alias("mean_spread"))
    return a.crossJoin(spread)  # one row by one row


def coverage_summary(cover: DataFrame, turnover: DataFrame) -> DataFrame:
    """D8. Share of eligible rows with a valid factor, and mean turnover."""
    a = cover.agg(F.sum("valid_factor_count").alias("valid_rows"), F.sum("eligible_count").alias("eligible_rows"), ratio(F.sum("valid_factor_count"), F.sum("eligible_count")).alias("factor_coverage"))
    return a.crossJoin(turnover.agg(F.avg("rank_turnover").alias("mean_rank_turnover")))


def tagged(df: DataFrame, segments: list[tuple[str, int, int]], horizon_ms: int) -> DataFrame:
    """D9. Rows with the named window [start, end) in which they and their horizon lie."""
    tag = F.lit(None).cast("string")
    for name, start, end in reversed(segments):
        tag = F.when((ms("timestamp") >= start) & (ms("timestamp") + horizon_ms <= end), name).otherwise(tag)
    return df.withColumn("period", tag).where("period is not null")


def by_period(ic: DataFrame) -> DataFrame:
    """D10. Statistics of each period and of all, by grouping sets."""
    return ic.rollup("period").agg(
        F.count("rank_ic").alias("observations"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_pop("rank_ic").alias("std_rank_ic"),
    ).withColumn("period", F.coalesce("period", F.lit("ALL")))


def pooled(stats: DataFrame) -> DataFrame:
    """D11. Mean and deviation of all periods from theirs: n (s^2 + (m - M)^2)."""
    n, m, s = F.col("observations"), F.col("mean_rank_ic"), F.col("std_rank_ic")
    total = stats.agg(F.sum("observations").alias("observations"), ratio(F.sum(n * m), F.sum(n)).alias("pooled_mean"), ratio(F.sum(n * (s * s + m * m)), F.sum(n)).alias("_q"))
    return total.select("observations", "pooled_mean", F.sqrt(F.greatest(F.col("_q") - F.col("pooled_mean") ** 2, F.lit(0.0))).alias("pooled_std"))
