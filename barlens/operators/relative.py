"""Comparison with a benchmark series.

The benchmark is ONE daily series, reduced to one row per calendar day whatever the
caller gives, so broadcasting it is bounded (36,525 rows in a hundred years) and a
repeated day multiplies no session.  It is aligned to each
ticker's own sessions first; returns are taken afterwards and never span a missing day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.nulls import growth
from ..vocab import FORWARD_HORIZONS


def align_benchmark(df: DataFrame, benchmark: DataFrame, price: str = "price") -> DataFrame:
    """Add ``benchmark_price`` by date; a day without one stays NULL."""
    series = benchmark.groupBy("date").agg(F.max(price).alias("benchmark_price"))
    return df.join(F.broadcast(series), "date", "left")


#: What the comparison reads from other sessions.
SERIES = {
    "benchmark_return": series.growth("benchmark_price"),
    **{f"fwd_benchmark_{h}d": series.growth("benchmark_price", -h) for h in FORWARD_HORIZONS},
    "_start_price": series.at_first("price", "benchmark_price"),
    "_start_benchmark": series.at_first("benchmark_price", "price"),
}


def compared() -> series.Step:
    """Abnormal returns, and the growth of both since the first session where both prices are known, from ``SERIES``."""
    stock = F.try_divide(F.col("price"), F.col("_start_price"))
    bench = F.try_divide(F.col("benchmark_price"), F.col("_start_benchmark"))
    return (
        {"abnormal_return": F.col("daily_return") - F.col("benchmark_return")}
        | {f"fwd_abnormal_{h}d": F.col(f"fwd_return_{h}d") - F.col(f"fwd_benchmark_{h}d") for h in FORWARD_HORIZONS}
        | {"cum_return": stock - 1, "benchmark_cum_return": bench - 1, "relative_performance": growth(stock, bench)}
    )
