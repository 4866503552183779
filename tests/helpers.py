"""Loop versions of recursive formulas, and small bar frames."""

from __future__ import annotations

import datetime as dt

import numpy as np

BARS = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"


def weekdays(n: int, start: dt.date = dt.date(2020, 1, 1)) -> list[dt.date]:
    days, day = [], start
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


def walk(spark, n: int = 400, seed: int = 3, ticker: str = "T", shocks: dict | None = None, adj: bool = True):
    """Seeded random walk with planted (return, volume multiplier) shocks by row."""
    rng = np.random.default_rng(seed)
    returns = rng.normal(0, 0.015, n)
    volume = np.round(np.exp(rng.normal(0, 0.25, n)) * 1e6)
    for row, (r, k) in (shocks or {}).items():
        returns[row], volume[row] = r, volume[row] * k
    close = 100 * np.cumprod(1 + returns)
    spread = np.abs(rng.normal(0, 0.006, n))
    opened = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(opened, close) * (1 + spread), np.minimum(opened, close) * (1 - spread)
    rows = [
        (ticker, d, float(o), float(h), float(lo), float(c), float(c) if adj else None, float(v))
        for d, o, h, lo, c, v in zip(weekdays(n), opened, high, low, close, volume)
    ]
    return spark.createDataFrame(rows, BARS)


def aged_ema_loop(x, span):
    """An exponential average whose older part ages at missing values too."""
    a, y, weight, seen, out = 2 / (span + 1), np.nan, 1.0, 0, []
    for v in x:
        weight *= 1 - a
        if not np.isnan(v):
            y = v if np.isnan(y) else (weight * y + a * v) / (weight + a)
            weight, seen = 1.0, seen + 1
        out.append(y if seen >= span else np.nan)
    return np.array(out)


def ema_loop(x: np.ndarray, span: int) -> np.ndarray:
    out, a = np.full(len(x), np.nan), 2 / (span + 1)
    y = x[0]
    for i, v in enumerate(x):
        y = v if i == 0 else a * v + (1 - a) * y
        if i >= span - 1:
            out[i] = y
    return out


def wilder_loop(x: np.ndarray, period: int) -> np.ndarray:
    out, run, y = np.full(len(x), np.nan), 0, None
    for i, v in enumerate(x):
        run = 0 if np.isnan(v) else run + 1
        if y is None:
            if run == period:
                y = x[i - period + 1 : i + 1].mean()
        elif not np.isnan(v):
            y = (y * (period - 1) + v) / period
        if y is not None:
            out[i] = y
    return out


def column(df, name: str) -> np.ndarray:
    rows = df.select("date", name).orderBy("date").collect()
    return np.array([np.nan if r[1] is None else r[1] for r in rows], dtype=float)
