"""The fold over lots and chunks against the plain fold from boundary to boundary."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from crosspan.operators import valuation

KIND = "candidate string, idx long, symbol string, open double, mark double, target double, rebalance boolean, rate double"


def invented(seed, candidates=3, boundaries=60, names="abcde", gaps=0.0, rate=0.6):
    """Rows as ``boundary_rows`` makes them: a name from its target to the next rebalance at which it has an open."""
    rnd, rows = random.Random(seed), []
    price = {s: [100.0] for s in names}
    for s in names:
        for _ in range(boundaries):
            price[s].append(price[s][-1] * math.exp(rnd.gauss(0, 0.02)))
    missing = {(s, k) for s in names for k in range(1, boundaries) if rnd.random() < gaps}
    paid = {(s, k): rnd.gauss(0, 0.001) for s in names for k in range(boundaries) if rnd.random() < rate}
    for c in range(candidates):
        rebalances = sorted(rnd.sample(range(1, boundaries), 14))
        held: set[str] = set()
        for k in range(boundaries):
            rows.append((f"c{c}", k, None, None, None, None, k in rebalances, None))
            targets = {s: rnd.choice([-1, 1]) * rnd.random() * 0.4 for s in rnd.sample(names, rnd.randrange(0, 4)) if (s, k) not in missing} if k in rebalances else {}
            for s in sorted(held | set(targets)):
                real = (s, k) not in missing
                rows.append((f"c{c}", k, s, price[s][k] if real else None, price[s][k], targets.get(s), k in rebalances, paid.get((s, k))))
                if k in rebalances and real:
                    held.discard(s)
                    held |= {s} & set(targets)
    return rows


def states(df):
    return {(r.candidate, r.idx, r.symbol): r for r in df.collect()}


@pytest.mark.parametrize(("seed", "gaps", "costs", "chunk"), [(1, 0.0, 0.0, 64), (2, 0.0, 30.0, 2), (3, 0.2, 30.0, 1), (4, 0.2, 6.0, 3), (5, 0.5, 200.0, 64), (6, 0.1, 3000.0, 2)])
def test_lots_and_chunks_equal_the_plain_fold(spark, seed, gaps, costs, chunk):
    rows = spark.createDataFrame(invented(seed, gaps=gaps), KIND)
    paid = valuation.Costs(costs * 0.75, costs * 0.25)
    want, got = states(valuation.capped(rows, paid, 1e6)), states(valuation.fold(rows.repartition(3), paid, 1e6, chunk))
    small = {k for k, r in want.items() if k[2] is not None and abs(r.weight) < 1e-15 and abs(r.traded) < 1e-12}
    assert set(want) - small <= set(got) and len(got) > 100
    for k, r in want.items():
        if k in small:
            continue
        for name in ("weight", "quantity", "equity", "turnover", "funding", "traded", "mark", "entry_price"):
            a, b = getattr(got[k], name), getattr(r, name)
            assert (a is None) == (b is None or math.isnan(b)), (k, name, a, b)
            assert a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (k, name, a, b)


def test_a_limit_folds_the_candidate_as_a_whole(spark):
    rows = spark.createDataFrame(invented(7), KIND)
    capped = states(valuation.fold(rows, valuation.Costs(5.0, 0.0, 0.3), 1e6))
    assert max(r.turnover for r in capped.values()) <= 0.3 + 1e-12


def test_opening_a_name_without_an_open_is_refused(spark):
    rows = [("c", 0, None, None, None, None, False, None), ("c", 1, None, None, None, None, True, None), ("c", 1, "a", None, 5.0, 0.5, True, None)]
    with pytest.raises(Exception, match="has no open to trade at"):
        valuation.fold(spark.createDataFrame(rows, KIND), valuation.Costs(), 1e6).collect()


def test_no_python_without_a_limit(spark):
    out = valuation.fold(spark.createDataFrame(invented(8), KIND), valuation.Costs(5.0), 1e6)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    assert out.where(F.col("equity") <= 0).count() == 0


def test_what_loses_all_or_more_is_not_left_out_of_the_compounded_return(spark):
    """As SQL's ln: -1 gives -1, less gives NaN. Before, such a bar was left out and the rest compounded."""
    rows = [("even", 0.5), ("even", -0.2), ("lost", 0.5), ("lost", -1.0), ("more", 0.5), ("more", -1.5), ("none", None), ("none", 0.25)]
    table = spark.createDataFrame(rows, "candidate string, r double").select("candidate", *(F.col("r").alias(c) for c in ("net_return", "gross_price_return", "fee_cost", "slippage_cost", "funding_return", "turnover", "gross_exposure")))
    got = {r.candidate: (r.net_return, r.gross_return) for r in valuation.matrix_summary(table).collect()}
    assert all(math.isclose(x, 0.2) for x in got["even"]) and got["lost"] == (-1.0, -1.0)
    assert all(map(math.isnan, got["more"])) and all(math.isclose(x, 0.25) for x in got["none"])
