"""Cleaning of raw bars and the checks that go with it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.nulls import items, some, yes
from ..params import PERIOD_DAYS
from ..vocab import (
    BAR_COLUMNS,
    LONGEST_NORMAL_GAP_DAYS,
    OHLC_TOLERANCE,
    STALE_AFTER_DAYS,
    TICKER_PATTERN,
)


def normalize_ticker(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Upper-case trimmed symbol, NULL where it is not a valid one."""
    symbol = F.upper(F.trim(column))
    return df.withColumn(column, F.when(symbol.rlike(TICKER_PATTERN), symbol))


def dedupe_keep_last(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row per (ticker, date): the copy with the largest ``order``, and ``copies``.

    An aggregate, not a window: copies are combined before the shuffle, so a date
    with very many copies costs one row per map task.  Equal ``order`` values are
    broken by the row's values.
    """
    values = [c for c in raw.columns if c not in ("ticker", "date", order)]
    last = F.max(F.struct(order, *values)).alias("_last")
    return (
        raw.groupBy("ticker", "date")
        .agg(last, F.count("*").alias("copies"))
        .select("ticker", "date", *[F.col(f"_last.{c}").alias(c) for c in values], "copies")
    )


def drop_bad_close(df: DataFrame) -> DataFrame:
    return df.where(F.col("close") > 0)


def min_rows_guard(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows of tickers with at least ``least`` rows."""
    rows = F.count("*").over(Window.partitionBy("ticker"))
    return df.withColumn("_rows", rows).where(F.col("_rows") >= least).drop("_rows")


def null_negative_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))


def clean_prices(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Deduplicated usable bars; (ticker, date) is a key of the result."""
    bars = min_rows_guard(drop_bad_close(dedupe_keep_last(raw, order)))
    return null_negative_volume(bars).select("ticker", "date", *BAR_COLUMNS)


def _inconsistent() -> Column:
    known = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    outside = some(
        F.col("high") < F.col("low"),
        F.col("close") > F.col("high") * (1 + OHLC_TOLERANCE),
        F.col("close") < F.col("low") * (1 - OHLC_TOLERANCE),
    )
    return known & outside


def quality_report(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Counts per ticker of what cleaning removed or found suspicious."""
    usable = F.col("close") > 0
    negative = usable & (F.col("volume") < 0)
    checked = dedupe_keep_last(raw, order).groupBy("ticker").agg(
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        F.count_if(~yes(usable)).alias("bad_close_rows"),
        F.count_if(usable).alias("usable_rows"),
        F.count_if(negative).alias("negative_volume_days"),
        F.count_if(usable & (F.col("volume").isNull() | negative)).alias("missing_volume_days"),
        F.count_if(usable & (F.col("volume") == 0)).alias("zero_volume_days"),
        F.count_if(usable & _inconsistent()).alias("inconsistent_ohlc_days"),
    )
    return checked


def long_gaps(bars: DataFrame) -> DataFrame:
    """Per ticker: breaks of more than six calendar days, and the first three dates after one."""
    gap = F.datediff("date", F.lag("date").over(frames.sessions()))
    return (
        bars.withColumn("_gap", gap)
        .where(F.col("_gap") > LONGEST_NORMAL_GAP_DAYS)
        .groupBy("ticker")
        .agg(
            F.count("*").alias("long_gaps"),
            F.slice(F.sort_array(F.collect_list("date")), 1, 3).alias("examples"),
        )
    )


def choose_price_column(bars: DataFrame) -> DataFrame:
    """Add price_column, price_note and price: adjusted close only if every row has one."""
    ticker = Window.partitionBy("ticker")
    df = bars.withColumns(
        {
            "_all": F.bool_and(yes(F.col("adj_close") > 0)).over(ticker),
            "_any": F.count("adj_close").over(ticker) > 0,
        }
    )
    # The two notes.
    some_missing = (
        "Adjusted close was missing on some days, so returns use the unadjusted close; "
        "dividends are not included in returns."
    )
    none_known = (
        "No adjusted close available; returns use the close price (dividends not included)."
    )
    return df.withColumns(
        {
            "price_column": F.when(F.col("_all"), "adj_close").otherwise("close"),
            "price_note": F.when(
                ~F.col("_all"), F.when(F.col("_any"), some_missing).otherwise(none_known)
            ),
            "price": F.when(F.col("_all"), F.col("adj_close")).otherwise(F.col("close")),
        }
    ).drop("_all", "_any")


def trim_to_period(bars: DataFrame, period: str) -> DataFrame:
    """Rows of the last ``period`` of each ticker's own history."""
    if period == "max":
        return bars
    df = bars.withColumn("_last", F.max("date").over(Window.partitionBy("ticker")))
    if period == "ytd":
        recent = F.year("date") == F.year("_last")
    else:
        recent = F.col("date") >= F.date_sub("_last", PERIOD_DAYS[period])
    return df.where(recent).drop("_last")


def stale_tickers(bars: DataFrame, run_date: date) -> DataFrame:
    """Tickers whose last bar is more than a week older than the run date."""
    age = F.datediff(F.lit(run_date), "last_date")
    return (
        bars.groupBy("ticker")
        .agg(F.max("date").alias("last_date"))
        .withColumn("age_days", age)
        .where(F.col("age_days") > STALE_AFTER_DAYS)
    )


def short_history_flags(bars: DataFrame, zscore_window: int = 60) -> DataFrame:
    """Per ticker: row count and what it is too short for."""
    n = F.col("trading_days")
    return (
        bars.groupBy("ticker")
        .agg(F.count("*").alias("trading_days"))
        .withColumn(
            "flags",
            items(
                F.when(n <= zscore_window, "no_zscore"),
                F.when(n < 250, "ema_context_incomplete"),
                F.when((n >= 250) & (n < 500), "ema_context_young"),
            ),
        )
    )
