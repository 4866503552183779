"""Abnormal sessions: rule flags, event rows, counts."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import sessions
from ..functions.nulls import every, items, reached, some, yes
from ..params import EventParams, StatisticsParams
from ..vocab import (
    ANOMALY,
    EVENT_COLUMNS,
    OUTCOMES,
    PRICE_RULES,
    UNKNOWN_CATEGORY,
    UNVERIFIED,
    VOLUME_RULES,
)


def rule_flags(params: EventParams) -> dict[str, Column]:
    """One boolean per enabled rule, in reporting order; unknown inputs are false.

    A z-score that equals its threshold is flagged, whichever way its spread was rounded.
    """
    tests = {
        "return_zscore": (F.abs("return_zscore"), params.return_zscore_threshold),
        "abs_return": (F.abs("daily_return"), params.abs_return_threshold),
        "volume_ratio": (F.col("volume_ratio"), params.volume_ratio_threshold),
        "volume_zscore": (F.col("volume_zscore"), params.volume_zscore_threshold),
    }
    return {
        rule: yes(reached(value, threshold))
        for rule, (value, threshold) in tests.items()
        if threshold is not None
    }


def anomaly_type(price: Column, volume: Column) -> Column:
    return F.when(price & volume, ANOMALY.both).when(price, ANOMALY.price).otherwise(ANOMALY.volume)


def direction(r: Column) -> Column:
    return F.when(r > 0, "up").when(r < 0, "down").otherwise("flat")


def event_spacing(events: DataFrame) -> DataFrame:
    """Sessions since the ticker's previous event; needs ``session``."""
    return events.withColumn(
        "trading_days_since_prev_event", F.col("session") - F.lag("session").over(sessions())
    )


def _price_and_volume(params: EventParams) -> tuple[dict[str, Column], Column, Column]:
    flags = rule_flags(params)
    price = some(F.lit(False), *[flags[r] for r in PRICE_RULES if r in flags])
    volume = some(F.lit(False), *[flags[r] for r in VOLUME_RULES if r in flags])
    return flags, price, volume


def flag_sessions(stats: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """Every session with is_event, is_price_event, is_volume_event and direction."""
    flags, price, volume = _price_and_volume(params)
    return stats.withColumns(
        {
            "is_event": some(*flags.values()),
            "is_price_event": price,
            "is_volume_event": volume,
            "direction": direction(F.col("daily_return")),
        }
    )


def detect_events(
    stats: DataFrame, params: EventParams = EventParams(), benchmark: str | None = None
) -> DataFrame:
    """Event rows in the fixed layout, plus ``session``; research fields are still unknown."""
    flags, price, volume = _price_and_volume(params)
    have = set(stats.columns)
    absent = [c for c in (*OUTCOMES, "benchmark_return", "abnormal_return") if c not in have]
    df = stats.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else stats
    hits = event_spacing(df.where(some(*flags.values())))
    named = F.when(F.col("benchmark_return").isNotNull(), F.lit(benchmark))
    return hits.withColumns(
        {
            "event_date": F.col("date"),
            "benchmark": named.cast("string"),
            "direction": direction(F.col("daily_return")),
            "is_price_event": price,
            "is_volume_event": volume,
            "trigger_rules": F.concat_ws(",", items(*[F.when(f, r) for r, f in flags.items()])),
            "anomaly_type": anomaly_type(price, volume),
            "event_category": F.lit(UNKNOWN_CATEGORY),
            "event_description": F.lit(None).cast("string"),
            "source": F.lit(None).cast("string"),
            "verification_status": F.lit(UNVERIFIED),
            "notes": F.lit(None).cast("string"),
        }
    ).select(*EVENT_COLUMNS, "session")


def detection_provenance(
    events: DataFrame,
    params: EventParams = EventParams(),
    statistics: StatisticsParams = StatisticsParams(),
) -> DataFrame:
    """Add the settings of the run as JSON text."""

    def literal(value):
        return F.lit(value).cast("double") if value is None else F.lit(value)

    def block(settings: dict) -> Column:
        return F.struct(*[literal(v).alias(k) for k, v in settings.items()])

    settings = F.struct(
        block(asdict(params)).alias("events"), block(asdict(statistics)).alias("statistics")
    )
    text = F.to_json(settings, {"ignoreNullFields": "false"})
    return events.withColumn("detection_settings", text)


def direction_counts(events: DataFrame) -> DataFrame:
    """Event counts per ticker."""
    price, volume = yes(F.col("is_price_event")), yes(F.col("is_volume_event"))
    unknown = F.col("event_category") == UNKNOWN_CATEGORY
    return events.groupBy("ticker").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("direction") == d).alias(d) for d in ("up", "down", "flat")],
        F.count_if(price & volume).alias("price_and_volume"),
        F.count_if(price & ~volume).alias("price_only"),
        F.count_if(volume & ~price).alias("volume_only"),
        F.count_if(~yes(unknown)).alias("linked"),
        F.count_if(unknown).alias("unknown"),
    )


def top_events(events: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` events of each ticker in the given order.

    Catalyst turns the rank filter into a per-task top-n before the shuffle.
    """
    w = Window.partitionBy("ticker").orderBy(*order)
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_events(events: DataFrame, n: int = 30) -> DataFrame:
    return top_events(events, n, F.desc("event_date"))


def largest_moves(events: DataFrame, n: int = 3) -> DataFrame:
    scored = events.where(F.col("return_zscore").isNotNull())
    return top_events(scored, n, F.abs("return_zscore").desc(), F.asc("event_date"))


def chosen(min_abs_zscore: float | None = None, min_volume_ratio: float | None = None) -> Column:
    """The condition of ``event_filters`` on event rows or flagged sessions."""
    tests = [(F.abs("return_zscore"), min_abs_zscore), (F.col("volume_ratio"), min_volume_ratio)]
    return every(F.lit(True), *[x >= least for x, least in tests if least is not None])


def event_filters(
    events: DataFrame,
    min_abs_zscore: float | None = None,
    min_volume_ratio: float | None = None,
    tickers: list[str] | None = None,
) -> DataFrame:
    if tickers is not None:
        events = events.where(F.col("ticker").isin(*[t.upper() for t in tickers]))
    if min_abs_zscore is not None:
        events = events.where(F.abs("return_zscore") >= min_abs_zscore)
    if min_volume_ratio is not None:
        events = events.where(F.col("volume_ratio") >= min_volume_ratio)
    return events


def big_up_moves(events: DataFrame, zscore: float = 2.5, ratio: float = 2.0) -> DataFrame:
    return events.where(
        (F.col("return_zscore") >= zscore) & (F.col("volume_ratio") >= ratio)
    ).orderBy("event_date", "ticker")
