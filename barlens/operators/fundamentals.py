"""Company profile, snapshot metrics, annual metrics and ratios in one long table."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, growth, per, points
from ..vocab import (
    CALCULATED_METRICS,
    CURRENCY_UNKNOWN,
    FUNDAMENTAL_COLUMNS,
    PROFILE_KEYS,
    SNAPSHOT_METRICS,
    STATEMENT_METRICS,
)

ANNUAL_ORDER = tuple(m[0] for m in STATEMENT_METRICS) + tuple(m[0] for m in CALCULATED_METRICS)


def finite_float(text: Column) -> Column:
    """Double from text; words, booleans and infinities are NULL."""
    return finite(text.try_cast("double"))


def statements_unpivot(wide: DataFrame) -> DataFrame:
    """Year-end columns (named yyyy-MM-dd) to rows (ticker, statement, item, period_end, value)."""
    ends = [c for c in wide.columns if re.fullmatch(r"\d{4}-\d{2}-\d{2}", c)]
    return wide.unpivot(["ticker", "statement", "item"], ends, "period_end", "value").select(
        "ticker",
        "statement",
        "item",
        F.to_date("period_end").alias("period_end"),
        finite(F.col("value").cast("double")).alias("value"),
    )


def info_map_scan(info: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Typed numbers out of the info map, one column per key."""
    return info.select(
        "ticker", *[finite_float(F.try_element_at("info", F.lit(k))).alias(k) for k in keys]
    )


def profile(info: DataFrame) -> DataFrame:
    """First non-empty candidate of every profile field."""
    return info.select(
        "ticker",
        *[
            F.coalesce(*[F.nullif(F.try_element_at("info", F.lit(k)), F.lit("")) for k in keys]).alias(f)
            for f, keys in PROFILE_KEYS.items()
        ],
    )


def unit_resolve(unit_type: Column) -> Column:
    """Unit text from the unit type and the profile's currencies."""
    trading = F.coalesce("currency", F.lit(CURRENCY_UNKNOWN))
    financial = F.coalesce("financial_currency", "currency", F.lit(CURRENCY_UNKNOWN))
    return (
        F.when(unit_type == "money_trading", trading)
        .when(unit_type == "money_financial", financial)
        .when(unit_type == "per_share", F.concat(financial, F.lit("/share")))
        .otherwise(unit_type)
    )


def snapshot_fundamentals(info: DataFrame, retrieved: date, source_name: str) -> DataFrame:
    """One row per metric the info map has a finite number for."""
    who = profile(info).select("ticker", "currency", "financial_currency")
    metrics = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(label).alias("label"),
                F.lit(unit).alias("unit_type"),
                F.lit(key).alias("key"),
                finite_float(F.try_element_at("info", F.lit(key))).alias("value"),
            )
            for metric, key, unit, label in SNAPSHOT_METRICS
        ]
    )
    rows = info.select("ticker", F.explode(metrics).alias("m")).select("ticker", "m.*")
    return (
        rows.where(F.col("value").isNotNull())
        .join(who, "ticker")
        .select(
            "ticker",
            F.lit("snapshot").alias("period_type"),
            F.lit(retrieved).alias("period_end"),
            "metric",
            "label",
            "value",
            unit_resolve(F.col("unit_type")).alias("unit"),
            F.concat(F.lit(f"{source_name}, info['"), "key", F.lit("']")).alias("source"),
            F.lit(retrieved).alias("retrieved_at"),
        )
    )


def _line_items(spark: SparkSession) -> DataFrame:
    """The fixed (statement, item) -> metric dimension: 15 rows, safe to broadcast."""
    rows = [
        (statement, item, metric, label, unit, rank)
        for metric, statement, names, unit, label in STATEMENT_METRICS
        for rank, item in enumerate(names)
    ]
    return spark.createDataFrame(
        rows, "statement string, item string, metric string, label string, unit_type string, rank int"
    )


def annual_fundamentals(
    statements: DataFrame, profiles: DataFrame, retrieved: date, source_name: str
) -> DataFrame:
    """Statement metrics per fiscal year; the preferred line item with a value wins."""
    best = F.min(F.struct("rank", "item", "value", "statement", "label", "unit_type")).alias("b")
    chosen = (
        statements.where(F.col("value").isNotNull())
        .join(F.broadcast(_line_items(statements.sparkSession)), ["statement", "item"])
        .groupBy("ticker", "metric", "period_end")
        .agg(best)
        .select("ticker", "metric", "period_end", "b.*")
    )
    who = profiles.select("ticker", "currency", "financial_currency")
    return chosen.join(who, "ticker", "left").select(
        "ticker",
        F.lit("annual").alias("period_type"),
        "period_end",
        "metric",
        "label",
        "value",
        unit_resolve(F.col("unit_type")).alias("unit"),
        F.concat(
            F.lit(f"{source_name}, annual "), "statement", F.lit(" statement ("), "item", F.lit(")")
        ).alias("source"),
        F.lit(retrieved).alias("retrieved_at"),
    )


def calculated_ratios(annual: DataFrame, retrieved: date, source_name: str) -> DataFrame:
    """Margins, and growth over the previous PRESENT period if that is a year earlier."""
    w = Window.partitionBy("ticker").orderBy("period_end")

    def metric(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    year = annual.groupBy("ticker", "period_end").agg(
        *[metric(m).alias(m) for m in ("revenue", "gross_profit", "operating_income", "net_income")]
    )
    year = year.withColumns(
        {"_before": F.lag("revenue").over(w), "_end": F.lag("period_end").over(w)}
    )
    revenue = F.col("revenue")
    apart = F.datediff("period_end", "_end")
    comparable = (revenue > 0) & (F.col("_before") > 0) & apart.between(300, 430)
    values = {
        "revenue_growth": F.when(comparable, growth(revenue, F.col("_before"))),
        "gross_margin": per(F.col("gross_profit"), revenue),
        "operating_margin": per(F.col("operating_income"), revenue),
        "net_margin": per(F.col("net_income"), revenue),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(label).alias("label"),
                values[name].alias("value"),
                F.lit(unit).alias("unit"),
            )
            for name, unit, label in CALCULATED_METRICS
        ]
    )
    return (
        year.select("ticker", "period_end", F.explode(rows).alias("r"))
        .select("ticker", "period_end", "r.*")
        .where(F.col("value").isNotNull())
        .select(
            "ticker",
            F.lit("annual").alias("period_type"),
            "period_end",
            "metric",
            "label",
            "value",
            "unit",
            F.lit(f"Calculated from {source_name} annual statements").alias("source"),
            F.lit(retrieved).alias("retrieved_at"),
        )
    )


def collect_fundamentals(
    info: DataFrame, statements: DataFrame, retrieved: date, source_name: str
) -> DataFrame:
    """Snapshot, annual and calculated rows in the fixed layout."""
    annual = annual_fundamentals(statements, profile(info), retrieved, source_name)
    return (
        snapshot_fundamentals(info, retrieved, source_name)
        .unionByName(annual)
        .unionByName(calculated_ratios(annual, retrieved, source_name))
        .select(*FUNDAMENTAL_COLUMNS)
    )


def annual_table(records: DataFrame) -> DataFrame:
    """Annual values by metric and fiscal year, long: every year that the data holds.

    ``metric_no`` is the fixed order of the metrics, ``period_no`` counts the ticker's years back
    from its latest.
    """
    years = Window.partitionBy("ticker").orderBy(F.col("period_end").desc())
    return records.where(F.col("period_type") == "annual").select(
        "ticker", "metric", metric_no().alias("metric_no"), "period_end", F.dense_rank().over(years).cast("long").alias("period_no"), "value"
    )


def metric_no() -> Column:
    return points(F.col("metric"), {m: k for k, m in enumerate(ANNUAL_ORDER)}).cast("long")


def annual_table_complete(records: DataFrame) -> DataFrame:
    """Every expected metric for every year of every ticker that has annual rows, known or not."""
    table = annual_table(records)
    expected = table.select("ticker", "period_end", "period_no").distinct().withColumn(
        "metric", F.explode(F.array(*map(F.lit, ANNUAL_ORDER)))
    )
    values = table.select("ticker", "period_end", "metric", "value")
    return expected.join(values, ["ticker", "period_end", "metric"], "left").select(
        "ticker", "metric", metric_no().alias("metric_no"), metric_label(F.col("metric")).alias("label"), "period_end", "period_no", "value"
    )


def metric_label(metric: Column) -> Column:
    """Label of a metric; the annual wording wins where a name exists in both kinds."""
    labels = {m[0]: m[3] for m in SNAPSHOT_METRICS}
    labels |= {m[0]: m[4] for m in STATEMENT_METRICS}
    labels |= {m[0]: m[2] for m in CALCULATED_METRICS}
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, metric), metric)


def metric_labels(records: DataFrame) -> DataFrame:
    """Stored rows (which carry no label) with their labels."""
    return records.withColumn("label", metric_label(F.col("metric")))


def fundamentals_gaps(info: DataFrame, records: DataFrame) -> DataFrame:
    """Per ticker with an info map: which kind of rows is missing altogether."""
    kinds = records.groupBy("ticker").agg(
        F.count_if(F.col("period_type") == "snapshot").alias("snapshot_rows"),
        F.count_if(F.col("period_type") == "annual").alias("annual_rows"),
    )
    zero = F.lit(0).cast("long")
    return (
        info.select("ticker", (F.size("info") > 0).alias("has_info"))
        .join(kinds, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("snapshot_rows", zero).alias("snapshot_rows"),
            F.coalesce("annual_rows", zero).alias("annual_rows"),
            (F.col("has_info") & (F.coalesce("snapshot_rows", zero) == 0)).alias("no_snapshot"),
            (F.coalesce("annual_rows", zero) == 0).alias("no_annual"),
        )
    )


def fundamentals_fallback(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live rows, and stored ones for every (ticker, period type) without live rows.

    Of stored snapshots only the latest retrieval counts.  ``from_store`` tells them apart.
    """
    latest = F.max("period_end").over(Window.partitionBy("ticker", "period_type"))
    old = (
        stored.join(live.select("ticker", "period_type").distinct(), ["ticker", "period_type"], "left_anti")
        .withColumn("_latest", latest)
        .where((F.col("period_type") != "snapshot") | (F.col("period_end") == F.col("_latest")))
        .drop("_latest")
        .withColumns({"label": metric_label(F.col("metric")), "from_store": F.lit(True)})
    )
    fresh = live.withColumn("from_store", F.lit(False))
    return fresh.unionByName(old, allowMissingColumns=True).select(*FUNDAMENTAL_COLUMNS, "from_store")


def profile_fallback(live: DataFrame, stored: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The live profile unless it holds no value at all; then the stored one."""
    old = stored.select("ticker", *[F.col(c).alias(f"_s_{c}") for c in fields])
    nothing = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in fields]).isNull()
    return live.join(old, "ticker", "left").select(
        "ticker",
        *[F.when(nothing, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
    )
