"""Earnings calendars: raw table to clean releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite

# Accepted column names, first match wins.
TIME_NAMES = ("Earnings Date",)
VALUE_NAMES = {
    "eps_estimate": ("EPS Estimate",),
    "reported_eps": ("Reported EPS",),
    "surprise_pct": ("Surprise(%)", "Surprise (%)"),
}


def earnings_scan(raw: DataFrame, zone: str = "America/New_York", order: str = "ingest_seq") -> DataFrame:
    """(ticker, release_time, eps_estimate, reported_eps, surprise_pct), one row per time.

    Instants become wall time of the exchange; wall times are kept.  Copies of a
    release are reduced by an aggregate, so many copies are combined map-side: the first
    by ``order`` stays.  Without such a column the copy with the smallest values does.
    """
    name = next(n for n in TIME_NAMES if n in raw.columns)
    time = F.col(f"`{name}`")
    kind = dict(raw.dtypes)[name]
    if kind == "timestamp":
        time = F.from_utc_timestamp(F.to_utc_timestamp(time, F.current_timezone()), zone)
    elif kind == "string":
        time = time.try_cast("timestamp_ntz")

    def value(names: tuple[str, ...]) -> Column:
        known = next((n for n in names if n in raw.columns), None)
        if known is None:
            return F.lit(None).cast("double")
        return finite(F.col(f"`{known}`").try_cast("double"))

    return (
        raw.select(
            "ticker",
            time.cast("timestamp_ntz").alias("release_time"),
            F.col(order).alias("_order") if order in raw.columns else F.lit(0).alias("_order"),
            *[value(names).alias(c) for c, names in VALUE_NAMES.items()],
        )
        .where(F.col("release_time").isNotNull())
        .groupBy("ticker", "release_time")
        .agg(F.min(F.struct("_order", *VALUE_NAMES)).alias("_v"))
        .select("ticker", "release_time", *[f"_v.{c}" for c in VALUE_NAMES])
    )
