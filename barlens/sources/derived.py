"""Bars, calendars, statements and stored tables derived from the provided tables.

The provided tables hold no prices.  Each ``ticker`` is a (return flag, line
status) pair of ``lineitem`` within ten suppliers, so tickers grow with the data; its
daily close follows the day's discounts, weekends counting to Monday.  The benchmark ``MKT`` is the whole market without the 13th of each month, so that some
benchmark days are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BENCHMARK = "MKT"


def line_ticker() -> Column:
    """Ticker of a line item: AF, AO, NF, NO, RF, RO for the first ten suppliers, then AF1, ..."""
    ten = F.expr("CASE WHEN l_suppkey > 10 THEN CAST((l_suppkey - 1) DIV 10 AS STRING) ELSE '' END")
    return F.concat("l_returnflag", "l_linestatus", ten)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, open, high, low, close, adj_close, volume), benchmark included.

    One scan; the day sums are combined map-side before they are dealt out, and
    the benchmark is summed from the same dealt sums instead of from the line items.
    """
    sums = [
        F.sum("step").alias("step"),
        F.sum("volume").alias("volume"),
        F.max("qmax").alias("qmax"),
        F.min("qmin").alias("qmin"),
    ]
    day = (
        table(spark, sf_dir, "lineitem")
        .select(
            line_ticker().alias("ticker"),
            F.expr("date_add(to_date(l_shipdate), CASE dayofweek(l_shipdate) WHEN 7 THEN 2 WHEN 1 THEN 1 ELSE 0 END)").alias("date"),
            (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("step"),
            F.col("l_quantity").alias("volume"),
            F.col("l_quantity").alias("qmax"),
            F.col("l_quantity").alias("qmin"),
        )
        .groupBy("ticker", "date")
        .agg(*sums)
    )
    # a filter on the date itself would reach the scan, and the day sums would be dealt twice
    open_days = F.count_if(F.dayofmonth("date") != 13).alias("_open")
    market = day.groupBy("date").agg(*sums, open_days).where("_open > 0").drop("_open")
    day = day.unionByName(market.withColumn("ticker", F.lit(BENCHMARK)))
    w = Window.partitionBy("ticker").orderBy("date")
    scale = F.when(F.col("ticker") == BENCHMARK, 0.0008).otherwise(0.002)
    path = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return (
        day.withColumn("close", F.round(100 * F.exp(scale * path), 4))
        .withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
        .select(
            "ticker",
            "date",
            "open",
            F.round(F.greatest("open", "close") * (1 + 0.00021347 * F.col("qmax")), 4).alias("high"),
            F.round(F.least("open", "close") * (1 - 0.00021347 * F.col("qmin")), 4).alias("low"),
            "close",
            F.round(
                F.col("close") * F.pow(F.lit(0.99), (2001 - F.year("date")).cast("double")), 4
            ).alias("adj_close"),
            "volume",
        )
    )


def stocks(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("ticker") != BENCHMARK)


def benchmark(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("ticker") == BENCHMARK)


def dirty_bars(frame: DataFrame) -> DataFrame:
    """Raw rows with planted faults, in the order of ``ingest_seq``."""
    day = F.dayofmonth("date")
    faulty = frame.where(~((F.month("date") == 3) & (F.year("date") == 2000))).select(
        "ticker",
        "date",
        "open",
        F.when(day == 17, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(day != 7, F.col("close")).alias("close"),
        F.when(
            ~((F.col("ticker") == "RO") & (F.col("date") == F.lit("2000-06-01").cast("date"))),
            F.col("adj_close"),
        ).alias("adj_close"),
        F.when(day == 9, -F.col("volume"))
        .when(day == 11, F.lit(0.0))
        .when(day != 19, F.col("volume"))
        .alias("volume"),
        F.lit(1).cast("long").alias("ingest_seq"),
    )
    copies = faulty.where(day == 5).withColumns(
        {"close": F.col("close") + 0.01, "ingest_seq": F.lit(2).cast("long")}
    )
    return faulty.unionByName(copies)


def earnings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release for every order, of the ticker of its cheapest line, as UTC instants with the source's own names."""
    estimate = F.round(F.col("o_totalprice") / 100000, 2)
    reported = F.round(estimate * (F.lit(0.8) + F.lit(0.04) * (F.col("o_orderkey") % 11)), 2)
    local = F.timestamp_add("HOUR", (F.col("o_orderkey") % 21 + 3).cast("int"), F.col("o_orderdate").cast("timestamp"))
    owner = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min(F.struct("l_extendedprice", line_ticker().alias("ticker"))).alias("least"))
        .select("o_orderkey", "least.ticker")
    )
    return table(spark, sf_dir, "orders").join(owner, "o_orderkey").select(
        "ticker",
        F.col("o_orderkey").alias("ingest_seq"),
        F.to_utc_timestamp(local, "America/New_York").alias("Earnings Date"),
        estimate.alias("EPS Estimate"),
        reported.alias("Reported EPS"),
        F.round((F.try_divide(reported, F.when(estimate != 0, estimate)) - 1) * 100, 2).alias("Surprise(%)"),
    )


def fiscal_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The fiscal years that the data holds: one value a year, needed to name the columns of a wide table."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct().collect()
    return sorted(r["y"] for r in rows if r["y"] is not None)


def statements_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statements, one row per (ticker, statement, item) and one column per year end.

    Ticker RF has no figures for 1999, so growth into 2000 must stay unknown.
    """
    revenue = F.col("l_extendedprice")
    margin = F.col("l_extendedprice") * F.col("l_discount")
    sums = {
        ("income", "TotalRevenue"): F.sum(revenue),
        ("income", "GrossProfit"): F.sum(margin * 4),
        ("income", "TotalOperatingIncomeAsReported"): F.sum(margin * 2),
        ("income", "NetIncome"): F.sum(margin),
        ("balance", "TotalDebt"): F.sum(F.col("l_tax") * revenue),
        ("balance", "ShareIssued"): F.sum("l_quantity"),
    }
    yearly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            line_ticker().alias("ticker"),
            F.year("l_shipdate").alias("fiscal_year"),
        )
        .agg(*[F.round(s, 2).alias(f"{st}.{item}") for (st, item), s in sums.items()])
        .where(~((F.col("ticker") == "RF") & (F.col("fiscal_year") == 1999)))
    )
    lines = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(st).alias("statement"),
                    F.lit(item).alias("item"),
                    F.col(f"`{st}.{item}`").alias("value"),
                )
                for st, item in sums
            ]
        )
    ).alias("line")
    years = fiscal_years(spark, sf_dir)
    long = yearly.select("ticker", "fiscal_year", lines).select("ticker", "fiscal_year", "line.*")
    return (
        long.groupBy("ticker", "statement", "item")
        .pivot("fiscal_year", years)
        .agg(F.first("value"))
        .withColumnsRenamed({str(y): f"{y}-12-31" for y in years})
    )


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, info map<string,string>) with one infinite, one empty and one absent value."""
    agg = (
        table(spark, sf_dir, "lineitem")
        .groupBy(line_ticker().alias("ticker"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
            F.sum("l_quantity").alias("quantity"),
            F.count("*").alias("lines"),
        )
    )

    def entry(key: str, value: Column) -> list[Column]:
        return [F.lit(key), value.cast("string")]

    pairs = [
        *entry("shortName", F.concat(F.lit("Company "), F.col("ticker"))),
        *entry("longName", F.when(F.col("ticker") != "AO", F.concat(F.lit("The "), F.col("ticker"))).otherwise("")),
        *entry("exchange", F.lit("XTST")),
        *entry("sector", F.when(F.col("ticker").startswith("A"), "Industrials").otherwise("Energy")),
        *entry("currency", F.when(F.col("ticker") != "NO", "USD").otherwise("")),
        *entry("financialCurrency", F.when(F.col("ticker") == "RF", "EUR")),
        *entry("totalRevenue", F.col("revenue").cast("decimal(24,2)")),
        *entry("sharesOutstanding", F.col("quantity").cast("long")),
        *entry("trailingEps", F.col("lines")),
        *entry("forwardPE", F.lit("Infinity")),
        *entry("trailingPE", F.lit("not meaningful")),
        *entry("enterpriseToEbitda", F.lit(None)),
    ]
    return agg.select("ticker", F.create_map(*pairs).alias("info"))
