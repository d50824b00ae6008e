"""Barrier searches by blocks against walking the bars one by one."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from crosspan.operators import barriers
from crosspan.operators.barriers import Barriers

H = 3_600_000
T0 = 1704067200000


def walk(path, e, sign, b):
    """(place, reason, level) of the first touch."""
    best = e
    for k, (_, _, high, low) in enumerate(path):
        bad, good = (low, high) if sign > 0 else (high, low)
        tests = []
        if b.stop is not None:
            tests.append(("STOP_LOSS", e * (1 - sign * b.stop), -1))
        if b.trailing is not None and (b.activation is None or sign * best >= sign * e * (1 + sign * b.activation)):
            tests.append(("TRAILING_STOP", best * (1 - sign * b.trailing), -1))
        if b.take is not None:
            tests.append(("TAKE_PROFIT", e * (1 + sign * b.take), 1))
        for reason, level, way in tests:
            if way < 0 and sign * bad <= sign * level or way > 0 and sign * good >= sign * level:
                return k, reason, level
        best = max(best, high) if sign > 0 else min(best, low)
    return None


def market(seed, n, symbols="ab"):
    rnd, rows = random.Random(seed), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            o, c = p, p * math.exp(rnd.gauss(0, 0.004))
            p = c
            if rnd.random() < 0.97:
                rows.append((s, T0 + i * H, o, max(o, c) * (1 + rnd.random() * 0.002), min(o, c) * (1 - rnd.random() * 0.002), rnd.random() > 0.02))
    return rows


CASES = [
    (Barriers(0.03, 0.02, 0.04, 0.01), 50, False), (Barriers(0.06, 0.05, 0.09, 0.03), 700, False), (Barriers(None, 0.03, None, None), 300, True), (Barriers(0.02, None, None, None), 17, True),
    (Barriers(None, None, 0.05, None), 1000, False), (Barriers(0.08, 0.04, None, 0.0), 256, False), (Barriers(0.5, 0.06, 0.5, 0.05), 5000, True), (Barriers(0.03, 0.02, 0.04, 0.01), 1, False),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_blocks_equal_a_walk(spark, case):
    b, horizon, next_open = CASES[case]
    rows, rnd = market(case, 900), random.Random(case)
    bars = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, is_complete boolean").withColumn("open_time", F.timestamp_millis("t"))
    entries = [(k, rnd.choice("abc"), T0 + rnd.randrange(-5, 905) * H, rnd.choice(["LONG", "SHORT"]), 100 * math.exp(rnd.gauss(0, 0.05))) for k in range(80)]
    df = spark.createDataFrame(entries, "entry_id int, symbol string, t long, side string, entry_price double").withColumn("entry_time", F.timestamp_millis("t"))
    got = {r.entry_id: r for r in barriers.first_touch(df, bars, "1h", b, horizon, next_open).collect()}
    assert len(got) == len(entries)
    reasons = set()
    for k, s, t, side, e in entries:
        sign = 1 if side == "LONG" else -1
        path = sorted((u, o, h, low) for c, u, o, h, low, whole in rows if c == s and whole and t <= u < t + horizon * H)
        want = walk(path, e, sign, b)
        r = got[k]
        if want is None:
            assert (r.reason, r.exit_price, r.exit_bar) == ("NONE", None, None)
            continue
        place, reason, level = want
        reasons.add(reason)
        assert r.reason == reason and math.isclose(r.level, level, rel_tol=1e-12) and r.exit_bar.timestamp() * 1000 == path[place][0]
        price = (path[place + 1][1] if place + 1 < len(path) else None) if next_open else (max if (reason == "TAKE_PROFIT") == (sign > 0) else min)(path[place][1], level)
        assert (r.exit_price is None) == (price is None) and (price is None or math.isclose(r.exit_price, price, rel_tol=1e-12))
    assert reasons


def test_rows_of_an_entry_grow_with_the_logarithm(spark):
    """The blocks of a month of minutes are some dozens, and they make exactly its bars."""
    for first, end, levels in ((0, 43_200, 3), (17, 43_217, 3), (5, 5, 2), (3, 9, 2), (255, 257, 1), (1, 100_000, 4)):
        made = spark.range(1).select(F.explode(barriers.covering(F.lit(first).cast("long"), F.lit(end).cast("long"), levels)).alias("b")).select("b.*").orderBy("from").collect()
        covered = [k for r in made for k in range(r["from"], r["from"] + barriers.FAN**r.level)]
        assert covered == list(range(first, end)) and len(made) <= 2 * barriers.FAN * (levels + 1)
