"""What labels, structure states and readings need from a ticker's earlier sessions, as series.

``compute_indicators`` takes them in its last pass over the sorted sessions, so that no window deals and sorts the
wide rows again; a frame without them gets them in a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.nulls import yes
from ..functions.recurrence import apart


def inputs() -> dict[str, Column]:
    """Columns that the series read beside the indicators."""
    b = F.col("bb_pct_b")
    return {
        "_gap_ema": apart(F.col("ema9"), F.col("ema21")),
        "_gap_rsi": apart(F.col("rsi6"), F.col("rsi14")),
        "_upper_day": yes(b >= 0.9).cast("double"),
        "_lower_day": yes(b <= 0.1).cast("double"),
    }


def _lags(column: str, *sessions: int) -> dict[str, series.Series]:
    return {f"{lagged(column, n)}": series.lag(column, n) for n in sessions}


def lagged(column: str, n: int) -> str:
    """Name of the column's value ``n`` sessions before."""
    return f"_{column.lstrip('_')}_{n}_ago"


def _ends(column: str, n: int) -> dict[str, series.Series]:
    name = column.lstrip("_")
    return {f"_{name}_lowest": series.known(series.least, column, -n, -1), f"_{name}_highest": series.known(series.most, column, -n, -1)}


def ends(column: str) -> tuple[Column, Column]:
    """Least and greatest value of the sessions just before."""
    name = column.lstrip("_")
    return F.col(f"_{name}_lowest"), F.col(f"_{name}_highest")


LABELS = {
    **_ends("_gap_rsi", 3),
    **_ends("macd_hist", 3),
    **_ends("rsi6", 5),
    **_lags("macd_hist", 1, 3),
    "_least_rank": series.known(series.least, "bb_width_percentile", -9, 0),
    "_upper_days": series.upto(series.total, "_upper_day", 5),
    "_lower_days": series.upto(series.total, "_lower_day", 5),
}
STRUCTURE = {
    **_ends("_gap_ema", 3),
    **_lags("close", 1),
    **_lags("ema9", 1),
    **_lags("ema21", 1),
    **_lags("rsi6", 3),
    **_lags("macd_hist", 3),
}
CHANGES = {
    **_lags("_gap_ema", 1, 2, 3),
    **_lags("_gap_rsi", 1, 2, 3),
    **_lags("macd_hist", 1, 2, 3),
    **_lags("rsi6", 1, 3, 5),
    **_lags("rsi14", 5),
}
#: How many sessions of the ticker follow: 0 at its last one.
LEFT = {"_sessions_left": series.sessions_left("close")}
EVERYTHING = LABELS | STRUCTURE | CHANGES | LEFT


def prepared(df: DataFrame, wanted: dict[str, series.Series]) -> DataFrame:
    """The frame with the wanted series."""
    absent = {c: s for c, s in wanted.items() if c not in df.columns}
    if not absent:
        return df
    reads = {s.column for s in absent.values()} - set(df.columns)
    df = df.withColumns({c: x for c, x in inputs().items() if c in reads})
    return series.over_sessions(series.in_order(df), absent).drop(*reads)


def without(df: DataFrame, kept: list[str] = ()) -> DataFrame:
    """The frame without the series, but those of ``kept``."""
    return df.drop(*[c for c in (*EVERYTHING, *inputs()) if c in df.columns and c not in kept])
