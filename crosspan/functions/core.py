"""Column helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

FINER = 4  #: times the session's shuffle partitions for wide rows that are sorted twice in a task

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(duration: str) -> int:
    """Seconds of a duration such as 15m, 4h or 1d; there are no calendar months."""
    m = re.fullmatch(r"([1-9][0-9]*)([smhdw])", duration)
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m[1]) * UNITS[m[2]]


def bars_in(duration: str, interval: str) -> int:
    """How many bars of ``interval`` make ``duration``, which must be a multiple."""
    n, rest = divmod(seconds(duration), seconds(interval))
    if rest or not n:
        raise ValueError(f"{duration} isn't a multiple of {interval}")
    return n


def ms(column: Column | str) -> Column:
    return F.unix_millis(F.col(column) if isinstance(column, str) else column)


def is_finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it, which SQL engines without ANSI errors give: infinite or NaN where b is 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, a * F.lit(float("inf")))


def rounded_half(c: Column, digits: int) -> Column:
    """``c`` rounded as the oracle's SQL does it, a half after scaling away from 0. F.round goes by the decimals that
    are shown: 242.64999999999998 is 242.6 there and 242.7 here, since ten times it is 2426.5."""
    return F.round(c * 10.0**digits) / 10.0**digits


def by_symbol(*more: str) -> WindowSpec:
    return Window.partitionBy("symbol", *more).orderBy("open_time")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation from moments; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def average_rank(value: str | Column, *keys: str) -> Column:
    """Rank among rows of equal ``keys``; ties share the mean of their ranks."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0
