"""Column helpers: rounding that is the same in every engine, windows of an instrument and of a date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def own() -> WindowSpec:
    """An instrument's own bars in order; equal windows are sorted once."""
    return Window.partitionBy("instrument_id").orderBy("bar_idx")


def sessions() -> WindowSpec:
    """An instrument's rows in order of calendar session."""
    return Window.partitionBy("instrument_id").orderBy("session_idx")


def dates() -> WindowSpec:
    """All rows of a date."""
    return Window.partitionBy("trade_date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: Column | str, places: int = 6) -> Column:
    """Half up on the scaled double, so that any engine gives the same number."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def rolling(agg: Callable, x: Column | str, n: int, window: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null until there are n values."""
    frame = (window or own()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def change(x: Column | str, n: int, window: WindowSpec | None = None) -> Column:
    """x over its value n rows before, less 1."""
    return ratio(col(x), F.lag(col(x), n).over(window or own())) - 1


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that filters and later columns read as they are.

    Long chains of columns that use each other several times grow exponentially when the optimizer pushes a filter through them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
