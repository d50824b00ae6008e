"""Aggregates over the last n rows, or over a span of time, in work that doesn't grow with n.

Spark works out a sliding frame anew for every row, n values each. Here rows fall into blocks of n
rows: the window of a row is the end of the block before and the beginning of its own, so it is made
of one aggregate that runs forwards through a block and one that runs backwards. Nothing is taken
away from a sum, so none loses digits, and minima need no queue. Frames of at most ``DIRECT`` rows
are left to Spark, where they are cheaper; the values are the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DIRECT = 32


class Kind(NamedTuple):
    """An aggregate in parts: how they are taken, how those of two adjoining stretches are joined
    (each null where a stretch is empty), and what they tell once joined."""

    parts: tuple[Column, ...]
    joined: Callable[[Sequence[Column], Sequence[Column]], list[Column]]
    told: Callable[..., Column]


def either(a: Column, b: Column, both: Column) -> Column:
    return F.coalesce(both, a, b)


def plus(a: Column, b: Column) -> Column:
    return either(a, b, a + b)


def each(*ways: Callable[[Column, Column], Column]) -> Callable:
    return lambda a, b: [way(x, y) for way, x, y in zip(ways, a, b, strict=True)]


def total(c: Column) -> Kind:
    return Kind((F.sum(c),), each(plus), lambda s: s)


def counted(c: Column) -> Kind:
    return Kind((F.count(c),), each(plus), lambda n: n)


def lowest(c: Column) -> Kind:
    return Kind((F.min(c),), each(F.least), lambda m: m)


def highest(c: Column) -> Kind:
    return Kind((F.max(c),), each(F.greatest), lambda m: m)


def mean(c: Column) -> Kind:
    return Kind((F.sum(c), F.count(c)), each(plus, plus), lambda s, n: F.try_divide(s, n))


def moments(x: Column, y: Column, told: Callable[..., Column]) -> Kind:
    """Count, and central moments xx, yy and xy of the rows that have both; ``told`` gets these four.

    Those of two stretches are joined by their means' distance. A side that is constant has exactly
    no spread, whatever the means round to.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = (F.count(x), F.avg(x), F.avg(y), F.var_pop(x), F.var_pop(y), F.covar_pop(x, y), F.min(x), F.max(x), F.min(y), F.max(y))

    def joined(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        n = plus(a[0], b[0])
        share, dx, dy = F.try_divide(a[0] * b[0], n * n), b[1] - a[1], b[2] - a[2]
        middle = lambda k: either(a[k], b[k], F.try_divide(a[k] * a[0] + b[k] * b[0], n))
        spread = lambda k, d: either(a[k], b[k], F.try_divide(a[k] * a[0] + b[k] * b[0], n) + share * d)
        return [n, middle(1), middle(2), spread(3, dx * dx), spread(4, dy * dy), spread(5, dx * dy), F.least(a[6], b[6]), F.greatest(a[7], b[7]), F.least(a[8], b[8]), F.greatest(a[9], b[9])]

    def finish(n, mx, my, xx, yy, xy, lx, hx, ly, hy):  # noqa: ANN001, ANN202
        moved = lambda low, high, v: F.when(low == high, 0.0).otherwise(v)
        return told(n, moved(lx, hx, xx), moved(ly, hy, yy), F.when((lx == hx) | (ly == hy), 0.0).otherwise(xy))

    return Kind(parts, joined, finish)


def deviation(c: Column, ddof: int) -> Kind:
    return moments(c, c, lambda n, xx, yy, xy: F.when(n > ddof, F.sqrt(xx * n / (n - ddof))))


def correlation(x: Column, y: Column) -> Kind:
    return moments(x, y, lambda n, xx, yy, xy: F.try_divide(xy, F.sqrt(xx * yy)))


def whole(kind: Kind, c: Column, n: int) -> Kind:
    """``kind``, null unless all n rows of the window have ``c``."""
    return Kind((F.count(c), *kind.parts), lambda a, b: [plus(a[0], b[0]), *kind.joined(a[1:], b[1:])], lambda m, *rest: F.when(m == n, kind.told(*rest)))


def numbered(df: DataFrame, keys: Sequence[str], order: str = "open_time") -> DataFrame:
    """``_at``: the row's place among those of its keys, from 0."""
    return df.withColumn("_at", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def frame(keys: Sequence[str], order: str, n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)


def rolled(df: DataFrame, wanted: dict[str, tuple[Kind, int]], keys: Sequence[str], order: str = "open_time") -> DataFrame:
    """``df``, which has ``_at``, with a column for each name: a kind over the last n rows (fewer at the beginning)."""
    direct = {name: kind.told(*(p.over(frame(keys, order, n)) for p in kind.parts)) for name, (kind, n) in wanted.items() if n <= DIRECT}
    out = df.withColumns(direct) if direct else df
    for n in sorted({n for _, n in wanted.values() if n > DIRECT}):
        own = {name: kind for name, (kind, m) in wanted.items() if m == n}
        block = F.floor(F.col("_at") / n)
        running = lambda o: Window.partitionBy(*keys, block).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)  # noqa: B023, E731
        heads = {f"_h_{name}_{k}": p.over(running(F.col(order))) for name, kind in own.items() for k, p in enumerate(kind.parts)}
        tails = {f"_t_{name}_{k}": p.over(running(F.col(order).desc())) for name, kind in own.items() for k, p in enumerate(kind.parts)}
        # The tail of the block before begins n - 1 rows ago; a block's last row has all of its window in its head.
        before = {c: F.when(F.col("_at") % n != n - 1, F.lag(c, n - 1).over(Window.partitionBy(*keys).orderBy(order))) for c in tails}
        out = out.withColumns(tails).withColumns(heads).withColumns(before)
        named = lambda side, name, kind: [F.col(f"_{side}_{name}_{k}") for k in range(len(kind.parts))]
        out = out.withColumns({name: kind.told(*kind.joined(named("t", name, kind), named("h", name, kind))) for name, kind in own.items()}).drop(*heads, *tails)
    return out


class Windows:
    """Collects window values while a column is being built from them; :meth:`added` works them out.

    Each call returns the column that will hold the value, so values can be made of others: the mean
    of a lag, the lag of a mean. Values that need no others are worked out together.
    """

    def __init__(self, keys: Sequence[str] = ("symbol", "segment"), order: str = "open_time") -> None:
        self.keys, self.order = tuple(keys), order
        self.asked: list[tuple[str, int, Kind | Column, int | None]] = []  # name, level, what, rows

    def ask(self, what: Kind | Column, n: int | None, *inputs: Column) -> Column:
        read = set(re.findall(r"\b_w\d+\b", " ".join(map(str, inputs))))
        name, level = f"_w{len(self.asked)}", 1 + max((x[1] for x in self.asked if x[0] in read), default=0)
        self.asked.append((name, level, what, n))
        return F.col(name)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def lag(self, c: Column, n: int) -> Column:
        return self.ask(F.lag(c, n).over(self.window), None, c)

    def over(self, kind: Kind, n: int, *inputs: Column) -> Column:
        """``kind`` over the last n rows; ``inputs``: the columns it reads."""
        return self.ask(kind, n, *inputs)

    def mean(self, c: Column, n: int) -> Column:
        return self.over(whole(mean(c), c, n), n, c)

    def sum(self, c: Column, n: int) -> Column:
        return self.over(whole(total(c), c, n), n, c)

    def min(self, c: Column, n: int) -> Column:
        return self.over(whole(lowest(c), c, n), n, c)

    def max(self, c: Column, n: int) -> Column:
        return self.over(whole(highest(c), c, n), n, c)

    def std(self, c: Column, n: int, ddof: int = 1) -> Column:
        return self.over(whole(deviation(c, ddof), c, n), n, c)

    def corr(self, x: Column, y: Column, n: int) -> Column:
        both = F.when(x.isNotNull(), y)
        return self.over(whole(correlation(x, y), both, n), n, x, y)

    def added(self, df: DataFrame) -> DataFrame:
        out = numbered(df, self.keys, self.order) if self.asked and "_at" not in df.columns else df
        for level in sorted({x[1] for x in self.asked}):
            own = [x for x in self.asked if x[1] == level]
            plain = {name: what for name, _, what, n in own if n is None}
            out = out.withColumns(plain) if plain else out
            out = rolled(out, {name: (what, n) for name, _, what, n in own if n is not None}, self.keys, self.order)
        return out


def at_times(rows: DataFrame, times: DataFrame, width: int, wanted: dict[str, Kind], key: str = "symbol", time: str = "t") -> DataFrame:
    """For each (key, time) of ``times``: kinds of the ``rows`` in (time - width, time], as in :func:`rolled`.

    Blocks are of ``width`` units of time. A time stands among the rows twice: at its own place, where
    a block's beginning ends, and ``width`` before, where the end of the block before begins. One
    shuffle by key; a time without rows gets nulls (0 for a count).
    """
    kinds = dict(rows.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns if c not in (key, time)]
    own = times.select(key, time).distinct()
    mark = lambda by, side: own.select(key, (F.col(time) - by).alias(time), F.col(time).alias("_for"), F.lit(side).alias("_side"), *none)
    # At one moment: rows come before the time that includes them, and the mark of a time that doesn't comes after them.
    both = rows.withColumns({"_for": F.lit(None).cast(kinds[time]), "_side": F.lit(0)}).unionByName(mark(0, 1)).unionByName(mark(width, 2))
    block = F.floor(F.col(time) / width)
    running = lambda *o: Window.partitionBy(key, block).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    names = [(name, k) for name, kind in wanted.items() for k in range(len(kind.parts))]
    both = both.withColumns({f"_t_{name}_{k}": wanted[name].parts[k].over(running(F.col(time).desc(), F.col("_side").desc())) for name, k in names})
    both = both.withColumns({f"_h_{name}_{k}": wanted[name].parts[k].over(running(F.col(time), F.col("_side"))) for name, k in names})
    side = lambda s, c: F.max(F.when(F.col("_side") == s, F.col(c))).alias(c)
    met = both.where("_side > 0").groupBy(key, F.col("_for").alias(time)).agg(*(side(2, f"_t_{name}_{k}") for name, k in names), *(side(1, f"_h_{name}_{k}") for name, k in names))
    parts = lambda s, name: [F.col(f"_{s}_{name}_{k}") for k in range(len(wanted[name].parts))]
    return met.select(key, time, *(kind.told(*kind.joined(parts("t", name), parts("h", name))).alias(name) for name, kind in wanted.items()))
