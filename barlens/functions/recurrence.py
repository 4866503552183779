"""Recursive averages of a ticker's sessions, and comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series

#: Part of their size by which two recursive averages may differ from rounding alone: a step adds a relative error of
#: 1e-16, a thousand steps may still count, and differences of averages pass it on.
NOISE = 1e-11


def apart(x: Column, y: Column, size: Column | None = None) -> Column:
    """x - y, exactly 0 where they differ by no more than rounding; ``size`` is what both were made from."""
    size = F.greatest(F.abs(x), F.abs(y)) if size is None else F.abs(size)
    return F.when(F.abs(x - y) <= NOISE * size, 0.0).otherwise(x - y)


def ema(df: DataFrame, averages: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponential averages ``{name: (column, span)}``, first ``span - 1`` values hidden."""
    return smooth(df, averages, {})


def wilder(df: DataFrame, averages: dict[str, tuple[str, int]]) -> DataFrame:
    """Wilder averages ``{name: (column, period)}``."""
    return smooth(df, {}, averages)


def smooth(
    df: DataFrame, emas: dict[str, tuple[str, int]], wilders: dict[str, tuple[str, int]]
) -> DataFrame:
    """Both kinds of average in one pass over the sorted history."""
    found = {n: series.ema(*spec) for n, spec in emas.items()} | {n: series.wilder(*spec) for n, spec in wilders.items()}
    return series.over_sessions(series.in_order(df), found)
