"""Ranks by ranges of rows against windows, with a timestamp in many parts."""

from __future__ import annotations

import functools
import operator
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspan.functions import ranks
from crosspan.functions.core import average_rank
from crosspan.operators import crosssection


def table(spark, n=6000):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), f"s{i}", rnd.choice([None, 1.0, 2.0, rnd.random() * 3, float("nan")])) for i in range(n)]
    return spark.createDataFrame(rows, "timestamp long, symbol string, value double")


def test_places_equal_row_numbers(spark):
    w = Window.partitionBy("timestamp")
    df = table(spark).withColumns({"want": F.row_number().over(w.orderBy(F.desc("value"), "symbol")), "n": F.count("*").over(w)})
    out = ranks.placed(df, ("timestamp",), F.desc("value"), F.asc("symbol"))
    assert out.count() == 6000 and out.where("want <> _place or n <> _size").count() == 0
    assert out.columns == [*df.columns, "_place", "_size"]


def test_ties_share_their_rank(spark):
    df = table(spark).withColumn("want", average_rank("value", "timestamp"))
    out = ranks.tied(df, ("timestamp",), "value")
    assert out.count() == 6000 and out.where("want <> _rank + (_ties - 1) / 2.0").count() == 0
    assert ranks.tied(df.where("false"), ("timestamp",), "value").count() == 0


def test_a_time_is_shared_by_tasks(spark):
    df = table(spark).where("timestamp = 1 and value is not null and not isnan(value)")
    out = ranks.placed(df, ("timestamp",), F.asc("value"), F.asc("symbol"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_split_operators_equal_the_others(spark):
    df = table(spark).where("timestamp is not null").withColumns({"is_valid": F.col("value").isNotNull() & ~F.isnan("value"), "invalid_reason": F.lit(None).cast("string"), "factor_version": F.lit("f"), "universe_version": F.lit("u")})
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(crosssection.rank_snapshots(df, "m"), crosssection.rank_snapshots(df, "m", split=True))
    assert same(crosssection.rank01(df).where("is_valid").select("timestamp", "symbol", "value"), crosssection.rank01(df, split=True).where("is_valid"))


def test_kept_tables_are_removed(spark):
    from pathlib import Path

    from crosspan.functions import work

    path = Path(work.shared(spark, "gone").removeprefix("file://"))
    assert work.kept(table(spark, 50), "gone").count() == 50 and any(p.name.startswith("gone-") for p in path.parent.iterdir())
    work.clean(spark)
    assert not path.parent.exists()


def test_a_half_is_one_after_scaling(spark):
    from crosspan.functions.core import rounded_half

    df = spark.createDataFrame([(242.64999999999998,), (-242.64999999999998,), (0.25,), (-0.25,), (0.24,), (float("inf"),)], "v double")
    got = [r.x for r in df.select(rounded_half(F.col("v"), 1).alias("x")).collect()]
    assert got == [242.7, -242.7, 0.3, -0.3, 0.2, float("inf")]


def test_sums_in_order_do_not_depend_on_how_events_are_dealt(spark):
    """Users with the same values tie on volume, so that the next key decides; sums of parts differ in the last bits."""
    from crosspan.sources import panel

    values = (59.64, 48.33, 97.0, 79.79, 48.78)
    rows = [(k * 10 + i, 1704067200 + i, k, v) for i, v in enumerate(values) for k in range(6)]
    want = functools.reduce(operator.add, values)  # plain additions in order
    for order in (rows, rows[::-1], rows[3::4] + rows[::4] + rows[2::4] + rows[1::4]):
        events = spark.createDataFrame(order, "event_id long, s long, user_id long, value double").repartition(3).withColumn("ts", F.timestamp_seconds("s"))
        got = panel.bars_of(events, F.col("user_id").cast("string"), "1d", in_order=True).collect()
        assert len(got) == 6 and {r.quote_volume for r in got} == {want} and {r.volume for r in got} == {want / 2}


def test_sums_go_by_event_id_not_by_time(spark):
    """As SQL on one thread adds events up: in the order in which they are numbered, which repeated times don't have."""
    from crosspan.sources import panel

    values = (0.1, 0.2, 0.3, 0.7, 1e16, -1e16)
    want, by_time = (functools.reduce(operator.add, v) for v in (values, values[::-1]))
    assert want != by_time
    rows = [(i, 1704067200 - i, k, v) for i, v in enumerate(values) for k in range(3)]
    events = spark.createDataFrame([(e, s + 100, k, v) for e, s, k, v in rows[::-1]], "event_id long, s long, user_id long, value double").repartition(3).withColumn("ts", F.timestamp_seconds("s"))
    got = panel.bars_of(events, F.col("user_id").cast("string"), "1d", in_order=True).collect()
    assert len(got) == 3 and {r.quote_volume for r in got} == {want}
