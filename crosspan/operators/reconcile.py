"""Intents, fills and risk events held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRATEGY_PRIORITY = 400


def arbitrate(intents: DataFrame, cooldown: DataFrame | None = None) -> DataFrame:
    """X1. Per (fill_time, symbol) the lowest priority, then the first id, wins; names in cooldown lose
    their strategy intents. Losers stay, with zero delta and the reason."""
    j = intents.withColumn("_cool", F.lit(False))
    if cooldown is not None:
        marked = cooldown.select("symbol", F.lit(True).alias("_c")).distinct()
        j = intents.join(marked, "symbol", "left").withColumn("_cool", F.coalesce("_c", F.lit(False)) & (F.col("priority") == STRATEGY_PRIORITY)).drop("_c")
    w = Window.partitionBy("fill_time", "symbol")
    j = j.withColumn("_w", F.min(F.when(~F.col("_cool"), F.struct("priority", "instruction_id"))).over(w))
    accepted = F.coalesce(F.col("_w.instruction_id") == F.col("instruction_id"), F.lit(False)) & ~F.col("_cool")
    return j.withColumns({
        "winner_instruction_id": F.col("_w.instruction_id"), "outcome": F.when(accepted, "ACCEPTED").otherwise("SUPPRESSED"),
        "final_reason_code": F.when(F.col("_cool"), "COOLDOWN_ACTIVE").when(accepted, F.col("reason_code")).otherwise("SUPPRESSED_BY_HIGHER_PRIORITY"),
        "constrained_delta_notional": F.when(accepted, F.col("requested_delta_notional")).otherwise(0.0),
    }).drop("_cool", "_w")


def link_fills(trades: DataFrame, accepted: DataFrame) -> DataFrame:
    """X2 (J6). Trades with their instruction, instructions without a trade, and how each is linked."""
    links = accepted.select(F.col("instruction_id").alias("_i"), F.col("constrained_delta_notional").alias("_n"))
    counts = Window.partitionBy("instruction_id")
    linked = trades.join(links, F.col("instruction_id") == F.col("_i"), "left").withColumn("status", F.when(F.col("_i").isNull(), "UNKNOWN_INSTRUCTION").when(F.count("*").over(counts) > 1, "FILLED_TWICE").otherwise("LINKED"))
    unfilled = accepted.where("constrained_delta_notional <> 0").join(trades.select("instruction_id"), "instruction_id", "left_anti")
    return linked.select("instruction_id", "trade_id", "status").unionByName(unfilled.select("instruction_id", F.lit(None).cast(dict(trades.dtypes)["trade_id"]).alias("trade_id"), F.lit("NOT_FILLED").alias("status")))


def link_risk_events(events: DataFrame, instructions: DataFrame, fills: DataFrame) -> DataFrame:
    """X3. Risk events with the fill of their instruction, its suppression, or the end of the data."""
    f = fills.groupBy("instruction_id").agg(F.min("fill_time").alias("fill_time"), F.count_distinct("fill_time").alias("_n"))
    i = instructions.select("source_event_id", "instruction_id", F.col("outcome"))
    j = events.join(i, events.event_id == i.source_event_id, "left").join(f, "instruction_id", "left")
    per = j.groupBy("event_id").agg(F.min("fill_time").alias("fill_time"), F.count_distinct("fill_time").alias("_n"), F.max(F.when(F.col("outcome") == "SUPPRESSED", 1).otherwise(0)).alias("_s"), F.count("source_event_id").alias("_i"))
    status = F.when(F.col("_n") > 1, "SEVERAL_FILL_TIMES").when(F.col("_n") == 1, "FILLED").when(F.col("_s") == 1, "SUPPRESSED").otherwise("END_OF_DATA")
    return per.select("event_id", "fill_time", status.alias("status"))
