"""Reading bars: CSV exports, stored tables, and the choice between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import finite, number
from ..vocab import BAR_COLUMNS, COLUMN_ALIASES


class DataUnavailable(ValueError):
    """The input cannot serve as a bar table."""


def _standard_names(df: DataFrame) -> dict[str, str]:
    """Standard name -> input column, matched without regard to case."""
    present = {c.strip().lower(): c for c in df.columns}
    found = {}
    for name, aliases in COLUMN_ALIASES.items():
        match = next((present[a] for a in aliases if a in present), None)
        if match is not None:
            found[name] = match
    return found


ISO_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"


def _as_date(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    column = F.col(f"`{name}`")
    if kind != "string":
        return F.to_date(column)
    text = F.trim(column)
    # the whole text must be a date, or a date with a time and perhaps an offset
    iso = F.when(text.rlike(ISO_TIME), F.substring(text, 1, 10))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"))


def _as_number(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        return number(column)
    return finite(column.cast("double"))


def standardize_prices(raw: DataFrame, keep: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """``keep`` columns, then date, open, high, low, close, adj_close, volume.

    Rows without a readable date are dropped, absent columns are NULL, text numbers
    may hold ``$`` and thousands separators.
    """
    found = _standard_names(raw)
    for needed in ("date", "close"):
        if needed not in found:
            raise DataUnavailable(f"the price table has no {needed!r} column")
    return raw.select(
        *keep,
        _as_date(raw, found["date"]).alias("date"),
        *[
            (_as_number(raw, found[c]) if c in found else F.lit(None).cast("double")).alias(c)
            for c in BAR_COLUMNS
        ],
    ).where(F.col("date").isNotNull())


def read_prices_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Bars from CSV files with a header; every field is read as text."""
    return standardize_prices(spark.read.option("header", True).csv(path), keep)


def scan_prices(stored: DataFrame, *tickers: str) -> DataFrame:
    """Stored bars of the tickers in date order; the filter reaches the scan."""
    return (
        stored.where(F.col("ticker").isin(*tickers))
        .select("ticker", "date", *BAR_COLUMNS)
        .orderBy("ticker", "date")
    )


def scan_events(stored: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    chosen = stored if tickers is None else stored.where(F.col("ticker").isin(*tickers))
    return chosen.orderBy("ticker", "event_date")


def scan_fundamentals(stored: DataFrame, ticker: str) -> DataFrame:
    return stored.where(F.col("ticker") == ticker).orderBy("period_type", "period_end", "metric")


def scan_stock_profile(stored: DataFrame, ticker: str) -> DataFrame:
    return stored.where(F.col("ticker") == ticker)


def latest_price_update(stored: DataFrame) -> DataFrame:
    return stored.groupBy("ticker").agg(F.max("updated_at").alias("latest_update"))


def prefer_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first source that has the ticker, with the source's name.

    The best source is found with a map-side combined minimum, so a ticker with
    very many rows is never gathered in one task.
    """
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumns({"price_source": F.lit(name), "_rank": F.lit(rank)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    best = rows.groupBy("ticker").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["ticker", "_rank"], "left_semi").drop("_rank")
