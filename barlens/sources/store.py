"""Stored tables by ticker bucket and year: pruned reads, and merges that rewrite only what a batch touches.

A bucket is a hash of the ticker, so the number of folders is fixed by the layout, not by the number of
tickers.  Rows of a bucket and year lie in one file, sorted by key, so the filter on a ticker
also skips row groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

#: Buckets of a table; with a hundred years of bars this is 6,400 folders.
BUCKETS = 64


def bucket(ticker: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def _placed(df: DataFrame, day: str | None, buckets: int) -> DataFrame:
    df = df.withColumn("bucket", bucket(F.col("ticker"), buckets))
    return df.withColumn("year", F.year(day)) if day else df


def write_table(df: DataFrame, path: str, keys: list[str], day: str | None = None, buckets: int = BUCKETS, replace: str = "static") -> None:
    """Write rows under ``bucket`` and, with a date column ``day``, ``year``.

    ``replace`` "dynamic" replaces only the folders that get rows.
    """
    folders = ["bucket", "year"] if day else ["bucket"]
    placed = _placed(df, day, buckets).repartition(*folders).sortWithinPartitions(*folders, *keys)
    placed.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(*folders).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The whole table without its folder columns."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in ("bucket", "year") if c in df.columns])


def scan_table(
    spark: SparkSession, path: str, tickers: list[str], start: str | None = None, end: str | None = None, day: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of some tickers, and of some days, from the folders that can hold them."""
    df = spark.read.parquet(path)
    # constants: they fold into a list of folders before the table is listed
    df = df.where(F.col("bucket").isin(*[bucket(F.lit(t), buckets) for t in tickers]) & F.col("ticker").isin(*tickers))
    if day and start is not None:
        df = df.where((F.col(day) >= F.lit(start).cast("date")) & (F.col("year") >= F.year(F.lit(start).cast("date"))))
    if day and end is not None:
        df = df.where((F.col(day) <= F.lit(end).cast("date")) & (F.col("year") <= F.year(F.lit(end).cast("date"))))
    return df.drop(*[c for c in ("bucket", "year") if c in df.columns])


def merge_table(
    spark: SparkSession, path: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], day: str | None = None, buckets: int = BUCKETS
) -> int:
    """Merge a batch into a stored table; the number of folders rewritten.

    Only folders that the batch has keys in are read, merged and replaced: a key fixes its folder, so no
    other folder can change.  The batch is computed once.  Their number is bounded by the layout.
    """
    incoming = checkpointed(incoming)
    folders = ["bucket", "year"] if day else ["bucket"]
    touched = _placed(incoming, day, buckets).select(*folders).distinct().collect()
    if not touched:
        return 0
    stored = spark.read.parquet(path)
    if day:
        years: dict[int, list[int]] = {}
        for b, y in touched:
            years.setdefault(y, []).append(b)
        here = F.lit(False)
        for y, held in sorted(years.items()):
            here = here | ((F.col("year") == y) & F.col("bucket").isin(*sorted(held)))
    else:
        here = F.col("bucket").isin(*sorted(b for (b,) in touched))
    merged = merge(stored.where(here).drop(*folders), incoming)
    write_table(merged, path, keys, day, buckets, replace="dynamic")
    return len(touched)
