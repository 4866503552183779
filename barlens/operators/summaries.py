"""Per-ticker summaries of a statistics frame.

Everything is a hash aggregate by ticker with map-side combine, or a window on the
(ticker, date) sort the statistics already have.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import era_sessions, sessions
from ..functions.nulls import growth
from ..vocab import CLOSE_AVERAGES, FULL_PERIOD, PERFORMANCE_WINDOWS


def _ticker():
    return Window.partitionBy("ticker")


def ranked(df: DataFrame) -> DataFrame:
    """Add ``rows`` (sessions of the ticker) and ``from_end`` (1 = last session)."""
    df = df.withColumns(
        {
            "rows": F.count("*").over(_ticker()),
            "_pos": F.row_number().over(sessions()).cast("long"),
        }
    )
    return df.withColumn("from_end", F.col("rows") - F.col("_pos") + 1).drop("_pos")


def last_row(df: DataFrame) -> DataFrame:
    """The ticker's last session, on the sort that the frame already has: wide rows are not sorted again."""
    order = era_sessions() if "era" in df.columns else sessions()
    return df.withColumn("_next", F.lead(F.lit(True)).over(order)).where("_next IS NULL").drop("_next")


def tail(df: DataFrame, n: int) -> DataFrame:
    return ranked(df).where(F.col("from_end") <= n).drop("from_end", "rows")


def _at(column: str, sessions_back: int) -> Column:
    """Value of a column so many sessions before the last one (needs ``ranked``)."""
    return F.max(F.when(F.col("from_end") == sessions_back + 1, F.col(column)))


def _first(column: str) -> Column:
    return F.min(F.struct("date", column))[column]


def _last(column: str) -> Column:
    return F.max(F.struct("date", column))[column]


def performance_windows(stats: DataFrame) -> DataFrame:
    """(ticker, window, sessions, return); NULL where the history is too short."""
    wide = ranked(stats).groupBy("ticker").agg(
        _at("price", 0).alias("last"), *[_at("price", n).alias(f"p{n}") for _, n in PERFORMANCE_WINDOWS]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("window"),
                F.lit(n).cast("long").alias("sessions"),
                growth(F.col("last"), F.col(f"p{n}")).alias("window_return"),
            )
            for label, n in PERFORMANCE_WINDOWS
        ]
    )
    return wide.select("ticker", F.explode(rows).alias("r")).select("ticker", "r.*")


def ytd_return(stats: DataFrame) -> DataFrame:
    """Last price against the last price of any earlier year."""
    final = F.max("date").over(_ticker())
    earlier = F.when(F.year("date") < F.year("_final"), F.struct("date", "price"))
    return (
        stats.select("ticker", "date", "price")
        .withColumn("_final", final)
        .groupBy("ticker")
        .agg(_last("price").alias("last_price"), F.max(earlier)["price"].alias("base_price"))
        .withColumn("ytd_return", growth(F.col("last_price"), F.col("base_price")))
    )


def full_period_return(stats: DataFrame, days_per_year: int = 252) -> DataFrame:
    """First to last price, and per year where there is at least one year."""
    years = (F.col("trading_days") - 1) / days_per_year
    ratio = F.try_divide(F.col("_last"), F.col("_first"))
    return (
        stats.groupBy("ticker")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count("*").alias("trading_days"),
            _first("price").alias("_first"),
            _last("price").alias("_last"),
        )
        .withColumns(
            {
                "full_period_return": ratio - 1,
                "annualised_return": F.when(
                    years >= 1, F.pow(ratio, 1 / F.when(years >= 1, years)) - 1
                ),
            }
        )
        .drop("_first", "_last")
    )


def range_52w(stats: DataFrame, days_per_year: int = 252) -> DataFrame:
    """Highest and lowest close of the last year with the first date of each."""
    return (
        tail(stats.select("ticker", "date", "close"), days_per_year)
        .groupBy("ticker")
        .agg(
            F.max(F.struct("close", -F.unix_date("date"))).alias("hi"),
            F.min(F.struct("close", "date")).alias("lo"),
            _last("close").alias("last_close"),
        )
        .select(
            "ticker",
            "last_close",
            F.col("hi.close").alias("high_52w_close"),
            F.date_from_unix_date(-F.col("hi.col2")).alias("high_52w_date"),
            F.col("lo.close").alias("low_52w_close"),
            F.col("lo.date").alias("low_52w_date"),
            growth(F.col("last_close"), F.col("hi.close")).alias("close_vs_52w_high"),
        )
    )


def ma_distance(stats: DataFrame) -> DataFrame:
    last = last_row(stats.select("ticker", "date", "close", *[f"ma_{n}" for n in CLOSE_AVERAGES]))
    return last.select(
        "ticker",
        *[f"ma_{n}" for n in CLOSE_AVERAGES],
        *[growth(F.col("close"), F.col(f"ma_{n}")).alias(f"close_vs_ma_{n}") for n in CLOSE_AVERAGES],
    )


def return_distribution(stats: DataFrame) -> DataFrame:
    """Moments (bias-corrected), median, extremes with first dates, share of up days.

    ``median`` is per ticker, hence bounded by the calendar.
    """
    r, n = F.col("daily_return"), F.col("observations")
    g1, g2, std = F.col("_g1"), F.col("_g2"), F.col("std")
    flat = std == 0
    return (
        stats.where(r.isNotNull())
        .groupBy("ticker")
        .agg(
            F.count("*").alias("observations"),
            F.avg(r).alias("mean"),
            F.median(r).alias("median"),
            F.stddev_samp(r).alias("std"),
            F.skewness(r).alias("_g1"),
            F.kurtosis(r).alias("_g2"),
            F.min(F.struct(r.alias("r"), F.col("date"))).alias("_min"),
            F.max(F.struct(r.alias("r"), -F.unix_date("date"))).alias("_max"),
            F.avg((r > 0).cast("double")).alias("share_positive_days"),
        )
        .select(
            "ticker",
            "observations",
            "mean",
            "median",
            "std",
            F.when(n >= 3, F.when(flat, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)))
            .alias("skewness"),
            F.when(
                n >= 4,
                F.when(flat, 0.0).otherwise(
                    F.try_divide((n - 1).cast("double"), ((n - 2) * (n - 3)).cast("double"))
                    * ((n + 1) * g2 + 6)
                ),
            ).alias("excess_kurtosis"),
            F.col("_min.r").alias("min"),
            F.col("_min.date").alias("min_date"),
            F.col("_max.r").alias("max"),
            F.date_from_unix_date(-F.col("_max.col2")).alias("max_date"),
            "share_positive_days",
        )
    )


def tail_frequency(stats: DataFrame, threshold: float | None = 2.5) -> DataFrame:
    """Observed share of days beyond the threshold against a normal distribution's.

    No rows where the rule is switched off (``threshold`` None).
    """
    if threshold is None:
        return tail_frequency(stats.where(F.lit(False)))
    normal = math.erfc(threshold / math.sqrt(2))
    beyond = F.abs("return_zscore") >= threshold
    return (
        stats.where(F.col("return_zscore").isNotNull())
        .groupBy("ticker")
        .agg(
            F.count("*").alias("days_scored"),
            F.count_if(beyond).alias("days_beyond_threshold"),
            F.avg(beyond.cast("double")).alias("observed_share"),
        )
        .withColumns(
            {
                "threshold": F.lit(float(threshold)),
                "normal_expected_share": F.lit(normal),
                "ratio_to_normal": F.col("observed_share") / normal,
            }
        )
    )


def volatility_summary(stats: DataFrame, days_per_year: int = 252) -> DataFrame:
    r, year = F.col("daily_return"), math.sqrt(days_per_year)
    recent = F.when(F.col("from_end") <= days_per_year, r)
    return (
        ranked(stats.select("ticker", "date", "daily_return", "rolling_volatility"))
        .groupBy("ticker")
        .agg(
            _last("rolling_volatility").alias("current_rolling_annualised"),
            (F.stddev_samp(r) * year).alias("full_period_annualised"),
            F.when(F.count(recent) > 2, F.stddev_samp(recent) * year).alias("last_year_annualised"),
            F.stddev_samp(r).alias("daily_std"),
        )
    )


def max_drawdown(stats: DataFrame) -> DataFrame:
    """Deepest fall with its peak, first trough and first recovery dates.

    ``peak_price`` and ``peak_date`` already travel with every session, so the trough
    row knows its peak; the recovery is one conditional minimum.
    """
    worst = F.min(F.struct("drawdown", "date", "peak_price", "peak_date", "price")).over(_ticker())
    recovered = (F.col("date") >= F.col("w.date")) & (F.col("price") >= F.col("w.peak_price"))
    return (
        stats.select("ticker", "date", "price", "drawdown", "peak_price", "peak_date")
        .withColumn("w", worst)
        .groupBy("ticker")
        .agg(
            F.first("w").alias("w"),
            F.min(F.when(recovered, F.col("date"))).alias("recovery_date"),
            _last("drawdown").alias("current_drawdown"),
        )
        .select(
            "ticker",
            F.col("w.drawdown").alias("max_drawdown"),
            F.col("w.peak_date").alias("drawdown_peak_date"),
            F.col("w.peak_price").alias("drawdown_peak_price"),
            F.col("w.date").alias("trough_date"),
            F.col("w.price").alias("trough_price"),
            "recovery_date",
            "current_drawdown",
        )
    )


def volume_summary(stats: DataFrame) -> DataFrame:
    return last_row(stats.select("ticker", "date", "volume", "avg_volume", "volume_ratio")).select(
        "ticker",
        F.col("volume").alias("last_volume"),
        F.col("avg_volume").alias("avg_volume_previous_window"),
        F.col("volume_ratio").alias("last_volume_ratio"),
    )


def _paired(stats: DataFrame) -> DataFrame:
    both = F.col("price").isNotNull() & F.col("benchmark_price").isNotNull()
    return ranked(stats.where(both).select("ticker", "date", "price", "benchmark_price"))


def benchmark_windows(stats: DataFrame) -> DataFrame:
    """(ticker, window, stock_return, benchmark_return, difference) on shared sessions."""
    sizes = [n for _, n in PERFORMANCE_WINDOWS]
    wide = _paired(stats).groupBy("ticker").agg(
        F.count("*").alias("shared"),
        *[
            expression
            for c in ("price", "benchmark_price")
            for expression in (
                _at(c, 0).alias(f"{c}_last"),
                _first(c).alias(f"{c}_first"),
                *[_at(c, n).alias(f"{c}_{n}") for n in sizes],
            )
        ],
    )

    def row(label: str, base: str) -> Column:
        stock = growth(F.col("price_last"), F.col(f"price_{base}"))
        bench = growth(F.col("benchmark_price_last"), F.col(f"benchmark_price_{base}"))
        return F.struct(
            F.lit(label).alias("window"),
            stock.alias("stock_return"),
            bench.alias("benchmark_return"),
            (stock - bench).alias("difference"),
        )

    rows = [row(label, str(n)) for label, n in PERFORMANCE_WINDOWS] + [row(FULL_PERIOD, "first")]
    return (
        wide.where(F.col("shared") >= 2)
        .select("ticker", F.explode(F.array(*rows)).alias("r"))
        .select("ticker", "r.*")
    )


def beta_correlation(stats: DataFrame) -> DataFrame:
    """Beta and correlation over paired daily returns (more than 20 of them)."""
    r, b = F.col("daily_return"), F.col("benchmark_return")
    enough = (F.col("pairs") > 20) & (F.col("_var") > 0)
    return (
        stats.where(r.isNotNull() & b.isNotNull())
        .groupBy("ticker")
        .agg(
            F.count("*").alias("pairs"),
            F.var_samp(b).alias("_var"),
            F.covar_samp(r, b).alias("_cov"),
            F.corr(r, b).alias("_corr"),
        )
        .select(
            "ticker",
            "pairs",
            F.when(enough, F.try_divide("_cov", "_var")).alias("beta"),
            F.when(enough, F.col("_corr")).alias("correlation"),
        )
    )


def abnormal_volatility(stats: DataFrame, days_per_year: int = 252) -> DataFrame:
    """Spread of abnormal returns, last relative performance, and the shared period."""
    ar = F.col("abnormal_return")
    both = F.col("price").isNotNull() & F.col("benchmark_price").isNotNull()
    rp = F.when(
        F.col("relative_performance").isNotNull(), F.struct("date", "relative_performance")
    )
    std = F.when(F.count(ar) > 2, F.stddev_samp(ar))
    return stats.groupBy("ticker").agg(
        (F.count_if(both) >= 2).alias("available"),
        F.min(F.when(both, F.col("date"))).alias("overlap_start"),
        F.max(F.when(both, F.col("date"))).alias("overlap_end"),
        F.count_if(both).alias("overlap_days"),
        std.alias("abnormal_return_daily_std"),
        (std * math.sqrt(days_per_year)).alias("abnormal_return_annualised_std"),
        F.max(rp)["relative_performance"].alias("final_relative_performance"),
    )


def summarize_statistics(
    stats: DataFrame, zscore_threshold: float = 2.5, days_per_year: int = 252
) -> DataFrame:
    """One wide row per ticker.  ``stats`` is used by several aggregates: cache it if stored."""
    windows = performance_windows(stats)
    wide = windows.groupBy("ticker").agg(
        *[
            F.max(F.when(F.col("sessions") == n, F.col("window_return"))).alias(f"return_{n}_sessions")
            for _, n in PERFORMANCE_WINDOWS
        ]
    )
    parts = [
        full_period_return(stats, days_per_year),
        wide,
        ytd_return(stats).select("ticker", "ytd_return"),
        range_52w(stats, days_per_year),
        ma_distance(stats),
        return_distribution(stats),
        tail_frequency(stats, zscore_threshold),
        volatility_summary(stats, days_per_year),
        max_drawdown(stats),
        volume_summary(stats),
    ]
    return reduce(lambda a, b: a.join(b, "ticker", "left"), parts)


def summarize_benchmark(stats: DataFrame, days_per_year: int = 252) -> DataFrame:
    """One wide row per ticker."""
    full = benchmark_windows(stats).where(F.col("window") == FULL_PERIOD).drop("window")
    return (
        abnormal_volatility(stats, days_per_year)
        .join(beta_correlation(stats), "ticker", "left")
        .join(full, "ticker", "left")
    )


def returns_histogram(stats: DataFrame) -> DataFrame:
    """(ticker, bin, low, high, days, normal_days): equal-width bins of daily returns in percent.

    ``normal_days`` is a normal curve of the same mean and spread at the bin's centre.
    """
    returns = stats.where(F.col("daily_return").isNotNull()).select(
        "ticker", (F.col("daily_return") * 100).alias("x")
    )
    n = F.col("n")
    span = returns.groupBy("ticker").agg(
        F.count("*").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("_lo"),
        F.max("x").alias("_hi"),
    )
    half = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    span = span.select(
        "ticker",
        "n",
        "mean",
        "std",
        F.least(F.lit(100), F.greatest(F.lit(20), F.floor(F.sqrt(n) * 2))).cast("int").alias("bins"),
        (F.col("_lo") - half).alias("lo"),
        (F.col("_hi") + half).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    place = F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("lo")) / F.col("width")))
    counts = (
        returns.join(span, "ticker")
        .groupBy("ticker", place.cast("int").alias("bin"))
        .agg(F.count("*").alias("days"))
    )
    every_bin = span.withColumn("bin", F.explode(F.expr("sequence(0, bins - 1)")))
    low = F.col("lo") + F.col("bin") * F.col("width")
    centre = (low + F.col("width") / 2 - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    normal = n * F.col("width") * F.exp(-0.5 * centre * centre) / (F.col("std") * math.sqrt(2 * math.pi))
    return every_bin.join(counts, ["ticker", "bin"], "left").select(
        "ticker",
        F.col("bin").cast("long").alias("bin"),
        low.alias("low"),
        (low + F.col("width")).alias("high"),
        F.coalesce("days", F.lit(0)).alias("days"),
        normal.alias("normal_days"),
    )
