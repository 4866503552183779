"""Per-session statistics: returns, baselines, volatility, volume, drawdown, outcomes.

One window numbers the sessions of (ticker, date), which deals and sorts the rows where they do not lie so yet; one
pass over the sorted sessions takes the series (``functions.series``), and column expressions make the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import sessions
from ..functions.nulls import growth, per
from ..params import StatisticsParams
from ..vocab import (
    CLOSE_AVERAGES,
    EXCURSION_HORIZONS,
    FORWARD_HORIZONS,
    LEAST_RELATIVE_VOLUME_STD,
    LEAST_RETURN_STD,
    TRAILING_HORIZONS,
)
from . import relative

_DRAWDOWN = {"peak_price": series.peak("price"), "_peak_day": series.at_peak("_day", "price")}


def session_number(bars: DataFrame) -> DataFrame:
    """Add ``session``: 1, 2, ... per ticker."""
    return bars.withColumn("session", F.row_number().over(sessions()).cast("long"))


def _with_day(df: DataFrame) -> DataFrame:
    """The date as a number that series can read."""
    return df.withColumn("_day", F.unix_date("date").cast("double"))


def _falling() -> series.Step:
    return {
        "drawdown": growth(F.col("price"), F.col("peak_price")),
        "peak_date": F.date_from_unix_date(F.col("_peak_day").cast("int")),
    }


def add_drawdown(df: DataFrame) -> DataFrame:
    """Fall from the highest price so far, and when that price was first reached."""
    return series.over_sessions(series.in_order(_with_day(df)), _DRAWDOWN).withColumns(_falling()).drop("_day", "_peak_day")


def _series(params: StatisticsParams) -> dict[str, series.Series]:
    """What is read from other sessions."""
    baseline, volume = params.zscore_window, params.volume_window
    columns = {"_yesterday": series.lag("price"), "daily_return": series.growth("price")}
    columns |= {f"return_{n}d": series.growth("price", n) for n in TRAILING_HORIZONS}
    # simple averages of the unadjusted close, the day included
    columns |= {f"ma_{n}": series.upto(series.mean, "_close", n) for n in CLOSE_AVERAGES}
    columns |= _DRAWDOWN
    columns |= {f"fwd_return_{h}d": series.growth("price", -h) for h in FORWARD_HORIZONS}
    for h in EXCURSION_HORIZONS:
        columns[f"_highest_{h}"] = series.after(series.highest, "_high", h)
        columns[f"_lowest_{h}"] = series.after(series.lowest, "_low", h)
    return columns | {
        # of the sessions BEFORE the day
        "rolling_mean_return": series.before(series.mean, "daily_return", baseline),
        "rolling_std_return": series.before(series.std_samp, "daily_return", baseline),
        "_deviation": series.upto(series.std_samp, "daily_return", params.volatility_window),
        "avg_volume": series.before(series.mean, "volume", volume),
        "volume_std": series.before(series.std_samp, "volume", volume),
    }


def preparing() -> series.Step:
    """What the statistics' series read beside the bars, before any adjustment of these."""
    scale = F.try_divide(F.col("price"), F.col("close"))
    return {
        "_day": F.unix_date("date").cast("double"),
        "_close": F.col("close"),
        "_high": F.col("high") * scale,
        "_low": F.col("low") * scale,
    }


def statistic_series(params: StatisticsParams, compared: bool) -> dict[str, series.Series]:
    return _series(params) | (relative.SERIES if compared else {})


def statistics(params: StatisticsParams, compared: bool) -> list[series.Step]:
    """Formulas over the series; ``compared`` says that there is a ``benchmark_price``."""
    price, v = F.col("price"), F.col("volume")
    columns = {"log_return": F.ln(F.try_divide(price, F.col("_yesterday")))}
    for h in EXCURSION_HORIZONS:
        # best high and worst low of the next h sessions, against the day's price
        columns[f"mfe_{h}d"] = growth(F.col(f"_highest_{h}"), price)
        columns[f"mae_{h}d"] = growth(F.col(f"_lowest_{h}"), price)
    std, avg, spread = F.col("rolling_std_return"), F.col("avg_volume"), F.col("volume_std")
    columns |= {
        "return_zscore": (F.col("daily_return") - F.col("rolling_mean_return")) / F.when(std > LEAST_RETURN_STD, std),
        "rolling_volatility": F.col("_deviation") * math.sqrt(params.trading_days_per_year),
        "volume_ratio": per(v, avg),
        "volume_zscore": (v - avg) / F.when(spread > LEAST_RELATIVE_VOLUME_STD * avg, spread),
        **_falling(),
    }
    return [columns | (relative.compared() if compared else {})]


def add_statistics(priced: DataFrame, params: StatisticsParams = StatisticsParams()) -> DataFrame:
    """All statistics of bars that carry ``price`` (see ``cleaning.choose_price_column``).

    With ``benchmark_price`` (see ``relative.align_benchmark``) also those against the benchmark.
    """
    compared = "benchmark_price" in priced.columns
    made = [preparing(), statistic_series(params, compared), *statistics(params, compared)]
    df = session_number(priced)
    shown = dict.fromkeys([*df.columns, *[c for step in made for c in step]])
    return series.derived(df, made, [c for c in shown if not c.startswith("_")])
