"""Ranks of which no task holds all rows of a key.

A window by timestamp gives one task all rows of a time, so a daily panel keeps as many tasks at work
as it has days. Here rows are dealt by ranges of (key, order) and sorted there; a row's place is its
place in its part plus the rows of the key in the parts before, of which there is one number for each
key and part that meet: no more than keys and parts together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspan.functions.work import kept


def alike(keys: Sequence[str], other: DataFrame, names: Sequence[str], df: DataFrame) -> Column:
    """Equal keys, null like any value."""
    test = F.lit(True)
    for k, name in zip(keys, names, strict=True):
        test = test & df[k].eqNullSafe(other[name])
    return test


def placed(df: DataFrame, keys: Sequence[str], *order: Column, place: str = "_place", size: str = "_size") -> DataFrame:
    """``df`` with each row's ``place`` among those of its keys by ``order``, from 1, and how many they are.

    Rows are written once as they are dealt, since their parts must stay the same between counting
    and numbering. The counts are small and joined by what Spark knows of their size.
    """
    dealt = [*map(F.col, keys), *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *dealt).sortWithinPartitions(*dealt).withColumns({"_rk_part": F.spark_partition_id(), "_rk_at": F.monotonically_increasing_id()})
    ranged = kept(ranged, "ranged")
    names = [f"_rk_key{k}" for k in range(len(keys))]
    edges = ranged.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_rk_part").alias("_rk_of")).agg(F.min("_rk_at").alias("_rk_first"), F.count("*").alias("_rk_n"))
    w = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_rk_n").over(w.orderBy("_rk_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = kept(edges.select(*names, "_rk_of", (F.col("_rk_first") - before - 1).alias("_rk_first"), F.sum("_rk_n").over(w).alias("_rk_all")), "edges")
    out = ranged.join(edges, alike(keys, edges, names, ranged) & (ranged["_rk_part"] == edges["_rk_of"]))
    return out.select(*(ranged[c] for c in df.columns), (F.col("_rk_at") - F.col("_rk_first")).alias(place), F.col("_rk_all").alias(size))


def tied(df: DataFrame, keys: Sequence[str], value: str, rank: str = "_rank", ties: str = "_ties", size: str = "_size") -> DataFrame:
    """``df`` with ``rank``, one plus the number of smaller values of its keys, how many share the value, and how many rows the keys have."""
    ordered = placed(df, keys, F.col(value).asc(), place="_rk_place", size=size)
    by = (*keys, value)
    names = [f"_rk_by{k}" for k in range(len(by))]
    groups = ordered.groupBy(*(F.col(k).alias(n) for k, n in zip(by, names, strict=True))).agg(F.min("_rk_place").alias(rank), F.count("*").alias(ties))
    return ordered.join(groups, alike(by, groups, names, ordered)).drop("_rk_place", *names)
