"""Data quality of bars, and coverage of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.functions.core import by_symbol, is_finite, ms, ratio, seconds

PRICES = ("open", "high", "low", "close")
AMOUNTS = ("volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")
BAR_KEY = ("symbol", "interval", "open_time")


def duplicate_keys(df: DataFrame, key: tuple[str, ...] = BAR_KEY) -> DataFrame:
    """Q1. Rows less distinct keys, as one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"))


def checks(bars: DataFrame, required: tuple[str, ...] = (*BAR_KEY, *PRICES)) -> DataFrame:
    """Q2-Q6. All row checks in one pass: nulls, non-finite values, bad OHLC, prices not above 0, amounts."""
    o, h, low, c = (F.col(x) for x in PRICES)
    ordered = (low <= F.least(o, c)) & (F.least(o, c) <= F.greatest(o, c)) & (F.greatest(o, c) <= h)
    low_price = F.lit(False)
    for p in PRICES:
        low_price = low_price | (F.col(p) <= 0)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return bars.agg(
        F.count("*").alias("rows"), *(count(F.col(x).isNull()).alias(f"null_{x}") for x in required),
        *(count(F.col(x).isNotNull() & ~is_finite(F.col(x))).alias(f"non_finite_{x}") for x in (*PRICES, "volume", "quote_volume")),
        count(~ordered).alias("bad_ohlc"), count(low_price).alias("non_positive_price"), *(count(F.col(x) < 0).alias(f"negative_{x}") for x in AMOUNTS),
        count(F.col("taker_buy_volume") > F.col("volume") + 1e-12).alias("taker_over_volume"), count(F.col("taker_buy_quote_volume") > F.col("quote_volume") + 1e-9).alias("taker_over_quote"), count(F.col("trades") < 0).alias("negative_trades"),
    )


def gaps(bars: DataFrame) -> DataFrame:
    """Q7. By symbol and interval: bars that are missing between neighbours, and inconsistent steps."""
    step = F.element_at(F.create_map(*(x for k in ("1m", "5m", "15m", "1h", "4h", "6h", "1d") for x in (F.lit(k), F.lit(seconds(k) * 1000)))), F.col("interval"))
    d = bars.withColumns({"_s": step, "_d": ms("open_time") - ms(F.lag("open_time").over(by_symbol("interval")))})
    odd = (F.col("_d") <= 0) | (F.col("_d") % F.col("_s") != 0)
    out = d.groupBy("symbol", "interval").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(odd, F.lit(False))).alias("inconsistent"), F.coalesce(F.sum(F.when(~odd & (F.col("_d") > F.col("_s")), (F.col("_d") / F.col("_s")).cast("long") - 1)), F.lit(0)).alias("missing"))
    return out.withColumn("missing_ratio", ratio(F.col("missing"), F.col("rows") + F.col("missing")))


def gate(counts: DataFrame, policy: dict[str, int]) -> DataFrame:
    """Q8. The counts that exceed their limits, in the policy's order; passed if there are none."""
    errors = F.array_compact(F.array(*(F.when(F.col(name) > limit, F.upper(F.lit(name))) for name, limit in policy.items())))
    return counts.select(errors.alias("errors")).select(F.concat_ws(",", "errors").alias("errors"), (F.size("errors") == 0).alias("passed"))


def coverage(partitions: DataFrame, keys: tuple[str, ...] = ("dataset_version",)) -> DataFrame:
    """Q9, Q10. By version: partitions, rows, first and last time, most symbols, reports."""
    return partitions.groupBy(*keys).agg(
        F.count("*").alias("partitions"), F.sum("row_count").alias("rows"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.max("symbols").alias("max_symbols"), F.count_distinct("quality_report_id").alias("reports")
    )


def symbols_behind(partitions: DataFrame, sources: DataFrame, objects: DataFrame) -> DataFrame:
    """Q11. Symbols of the raw objects behind each version."""
    return partitions.join(sources, "partition_id").join(objects, "object_id").select("dataset_version", "symbol").distinct()


def requirements(required: DataFrame, cover: DataFrame, have: DataFrame) -> DataFrame:
    """Q12. Required (dataset_version, symbol, start, end): covered in time, and the symbol is there."""
    j = required.join(cover.select("dataset_version", "min_time", "max_time"), "dataset_version", "left").join(have.withColumn("_h", F.lit(True)), ["dataset_version", "symbol"], "left")
    inside = F.coalesce((F.col("min_time") <= F.col("start")) & (F.col("max_time") >= F.col("end")), F.lit(False))
    return j.select("dataset_version", "symbol", F.when(~inside, "WINDOW_NOT_COVERED").when(F.col("_h").isNull(), "SYMBOL_MISSING").otherwise("OK").alias("status"))


def inventory_status(expected: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Q13. Expected objects against the inventory (manifested, checksum, manifest_checksum)."""
    e, i = expected.withColumn("_e", F.lit(True)), inventory.withColumn("_i", F.lit(True))
    status = F.when(F.col("_i").isNull(), "missing").when(F.col("_e").isNull(), "orphan").when(~F.col("manifested"), "unmanifested").when(F.col("checksum") == F.col("manifest_checksum"), "verified").otherwise("conflict")
    return e.join(i, keys, "full_outer").select(*keys, status.alias("status"))


def lineage(partitions: DataFrame, sources: DataFrame) -> DataFrame:
    """Q14. Edges raw object -> partition -> version -> derived interval."""
    a = sources.select(F.col("object_id").alias("source"), F.col("partition_id").alias("target"), F.lit("raw").alias("kind"))
    b = partitions.select(F.col("partition_id").alias("source"), F.col("dataset_version").alias("target"), F.lit("partition").alias("kind"))
    c = partitions.select(F.col("dataset_version").alias("source"), F.concat_ws("/", "dataset_version", "interval").alias("target"), F.lit("derived").alias("kind"))
    return a.unionByName(b).unionByName(c).distinct()


def panel_stats(universe: DataFrame, factors: DataFrame) -> DataFrame:
    """Q16. Symbols, eligible symbols, factor rows and valid rows, and the range of cross-section sizes."""
    u = universe.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.when(F.col("is_eligible"), F.col("symbol"))).alias("eligible_symbols"))
    f = factors.groupBy("timestamp").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v")).agg(F.sum("n").alias("factor_rows"), F.sum("v").alias("valid_rows"), F.min("v").alias("ranked_min"), F.max("v").alias("ranked_max"))
    return u.crossJoin(f)  # one row by one row
