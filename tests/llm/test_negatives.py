"""Hard negatives against all anchors by all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspan.llm import negatives

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, low=80, high=100, size=5):
    sound = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, l) in enumerate(sound):
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, m == l) for h, (j, w, m) in enumerate(sound) if h != k]
        for p, j, _ in sorted(x for x in scored if x[2])[:size]:
            within = sorted((n, m) for n, m, same in scored if not same and low * -p <= 100 * -n <= high * -p)
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(within[:size])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rnd, n, width=6, labels=4):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [x + rnd.gauss(0, 0.5) for x in c], rnd.randrange(labels)))
    return out


def mined(spark, rows, every=10, **more):
    return negatives.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % every == 0, **more)


def test_equals_brute_force(spark):
    rows = vectors(random.Random(1), 600)
    assert got(mined(spark, rows)) == brute(rows, lambda i: i % 10 == 0)
    assert got(mined(spark, rows, low=50, high=90, positives=3, negatives=3)) == brute(rows, lambda i: i % 10 == 0, 50, 90, 3)


def test_rounds_do_not_matter(spark):
    rows = vectors(random.Random(2), 400)
    assert got(mined(spark, rows, every=4, group=13)) == got(mined(spark, rows, every=4)) == brute(rows, lambda i: i % 4 == 0)


def test_copies_ties_and_repeated_ids(spark):
    rnd = random.Random(3)
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(300)] + [(300 + i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)], i % 3) for i in range(300)] + [(30, [1.0, 0.5, 0.25], 0), (31, [1.0, 0.5, 0.2], 1)]
    assert got(mined(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    rows = vectors(random.Random(4), 120) + [
        (130, None, 1), (140, [1.0] * 6, None), (150, [1.0, None, 1.0], 1), (160, [math.nan] * 6, 1), (170, [math.inf] * 6, 1), (None, [1.0] * 6, 1), (180, [], 1), (190, [0.0] * 6, 1),
        (200, [1.0, -1.0], 1), (210, [0.3] * 9, 1), (220, [-2.0] * 6, 9), (221, [-0.5] * 6, 9), (222, [2.0] * 6, 8), (-10, [1.0] * 6, 1),
    ]
    want = brute(rows, lambda i: i % 10 == 0)
    assert got(mined(spark, rows)) == want
    clashing = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("row", "id", "q", "score", "anchor", "place", "rank", "is_anchor", "round")})
    assert got(negatives.hard_negatives(clashing, F.col("vec_id") % 10 == 0)) == want
    assert mined(spark, []).collect() == [] and mined(spark, rows, every=1009).where("anchor_id <> 0").collect() == []
    assert mined(spark, [r for r in rows if r[0] is not None and r[0] % 10]).collect() == []


def test_large_components_are_exact():
    rnd = np.random.default_rng(1)
    for top in (1 << 10, 1 << 26, 1 << 29):
        a, b = rnd.integers(-top, top, (5, 7)), rnd.integers(-top, top, (6, 7))
        assert (negatives.scores(a, b) == (a.astype(object) @ b.astype(object).T)).all()
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_walks_end_early_and_bounds_hold():
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(12, 16))
    rows = np.floor(256 * (centres[rnd.integers(0, 12, 6000)] + rnd.normal(0, 0.05, (6000, 16)))).astype(np.int64)
    ids, labels = np.arange(6000), rnd.integers(0, 3, 6000)
    own = negatives.Anchors(ids[:600], ids[:600], labels[:600], rows[:600])
    bounds = own.bounds(rows)
    exact = negatives.scores(own.vectors, rows)
    assert (exact <= own.lengths[:, None] * bounds[own.own]).all()
    best = negatives.Best(600, 5, np.full(600, -negatives.NEVER))
    done = negatives.walk(own, (rows, ids, labels, ids), True, best, np.full((600, 1), negatives.NEVER))
    assert done < 0.5 * sum((labels == k).sum() * (own.labels == k).sum() for k in range(3))
    for a in range(0, 600, 50):
        others = [c for c in range(6000) if labels[c] == own.labels[a] and c != own.rows[a]]
        assert list(best.found[a][1]) == sorted(others, key=lambda c: (-exact[a, c], c))[:5]
