"""The analysis flows, end to end: bars -> statistics -> events -> outcomes -> swing state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..operators import cleaning, daily_stats, detection, earlier, evidence, indicators, labels, outcomes
from ..operators import relative, structure, swing
from ..params import Params
from ..vocab import ABNORMAL_OUTCOMES, OUTCOMES


def statistics(bars: DataFrame, benchmark: DataFrame | None, params: Params = Params()) -> DataFrame:
    """Statistics of cleaned bars; ``benchmark`` is the benchmark's own cleaned bars.

    Each ticker's history is cut to ``params.period`` first.
    """
    return daily_stats.add_statistics(_priced(bars, benchmark, params), params.statistics)


def events(
    stats: DataFrame,
    params: Params = Params(),
    releases: DataFrame | None = None,
    source: str = "earnings calendar",
) -> DataFrame:
    """Detected events, linked to releases where there is a calendar."""
    found = detection.detect_events(stats, params.events, params.benchmark)
    if releases is None:
        return found
    windows = evidence.earnings_windows(
        releases, stats.select("ticker", "date", "session"), params.events.earnings_match_window_days
    )
    return evidence.match_evidence(found, windows, source)


def event_study(bars: DataFrame, benchmark: DataFrame | None, params: Params = Params()) -> DataFrame:
    """Outcomes per ticker and event group with the baseline, in one pass."""
    stats = statistics(bars, benchmark, params)
    return outcomes.session_outcomes(detection.flag_sessions(stats, params.events))


def _priced(bars: DataFrame, benchmark: DataFrame | None, params: Params) -> DataFrame:
    """Bars with the chosen price, and the benchmark's where there is one."""
    priced = cleaning.choose_price_column(cleaning.trim_to_period(bars, params.period))
    return priced if benchmark is None else relative.align_benchmark(priced, cleaning.choose_price_column(benchmark))


def _steps(params: Params, compared: bool) -> list[series.Step]:
    """From priced bars to statistics, indicators, labels, structure, condition and readings of every session.

    All that needs the bars alone is taken in one pass, whether of the statistics or of the indicators.
    """
    # labels are coded before the last pass: one generated method holds what follows it, and Java compiles none over 8,000 bytes
    texts = {"_trend_text": labels.label_trend(), "_zone_text": labels.label_rsi_zone(F.col("rsi6"))}
    coded = outcomes.coded(F.col("_trend_text"), F.col("_zone_text"))
    further = earlier.EVERYTHING | structure.level_series(params.technical.pivot_bars)
    beside = [daily_stats.statistic_series(params.statistics, compared), *daily_stats.statistics(params.statistics, compared)]
    return [
        daily_stats.preparing(),
        *indicators.adjusting(),
        *indicators.indicating(compared, further, [texts, earlier.inputs() | coded], beside),
        labels.labelling(),
        *structure.stating(),
        *labels.conditions(),
        swing.changing(),
        swing.reading(),
    ]


def taken(bars: DataFrame, benchmark: DataFrame | None, params: Params, *wanted: str) -> DataFrame:
    """Ticker, date and the wanted columns of every session: statistics, indicators, labels, states, changes, readings.

    Only what the wanted columns rest on is computed.
    """
    priced = series.numbered(_priced(bars, benchmark, params))
    return series.derived(priced, _steps(params, benchmark is not None), wanted)


def last_of(bars: DataFrame, benchmark: DataFrame | None, params: Params, *wanted: str) -> DataFrame:
    """The same of each ticker's last session."""
    return taken(bars, benchmark, params, *wanted, "_sessions_left").where("_sessions_left = 0").drop("_sessions_left")


def context_of(bars: DataFrame, benchmark: DataFrame | None, params: Params = Params()) -> DataFrame:
    """``context`` of the bars themselves: sessions stay in their task, and one row a ticker leaves it."""
    unknown = {} if benchmark is not None else {c: F.lit(None).cast("double") for c in ABNORMAL_OUTCOMES}
    steps = [*_steps(params, benchmark is not None), unknown, *outcomes.like_today()]
    today = series.derived(series.numbered(_priced(bars, benchmark, params)), steps, outcomes.today_columns(), last=True)
    return outcomes.context_rows(today, params.technical.min_history_samples)


def indicator_frame(
    bars: DataFrame,
    benchmark: DataFrame | None,
    params: Params = Params(),
    with_outcomes: bool = False,
    further: bool = False,
) -> DataFrame:
    """Indicators of every session on adjusted bars.

    Outcome columns ride along in the same rows instead of being joined back.  ``further`` adds the series of earlier
    sessions that labels, structure states and changes read (``operators.earlier``).
    """
    compared = benchmark is not None
    shown = ["open", "high", "low", "close", "adj_close", "volume", "price_column", *(["benchmark_price"] if compared else [])]
    made = indicators.made(compared)
    carried = [c for c in OUTCOMES if compared or "abnormal" not in c] if with_outcomes else []
    return taken(bars, benchmark, params, *shown, *carried, "filled_high_low", *made, *(earlier.EVERYTHING if further else ()))


def labelled(bars: DataFrame, benchmark: DataFrame | None, params: Params = Params()) -> DataFrame:
    """Indicators and labels of every session."""
    return earlier.without(labels.classify_all(indicator_frame(bars, benchmark, params, further=True)))


def technical(
    bars: DataFrame,
    benchmark: DataFrame | None,
    params: Params = Params(),
    with_outcomes: bool = False,
    changes: bool = False,
    last: bool = False,
) -> DataFrame:
    """Indicators, labels, structure and swing condition of every session.

    ``changes`` adds those of ``swing.with_changes``; with ``last`` only the tickers' last sessions are labelled.
    """
    frame = indicator_frame(bars, benchmark, params, with_outcomes, further=True)
    if last:
        frame = frame.where("_sessions_left = 0")
    frame = labels.swing_condition(structure.structure_states(labels.classify_all(frame)))
    return earlier.without(swing.with_changes(frame) if changes else frame)


def levels(technical: DataFrame, params: Params = Params()) -> DataFrame:
    """Support and resistance from the pivots of the settings' window."""
    settings = params.technical
    return structure.support_resistance(technical, settings.structure_lookback_days, settings.pivot_bars)


def chart(technical: DataFrame, params: Params = Params()) -> DataFrame:
    return swing.chart_window(technical, params.technical.chart_days)


def event_risk(last: DataFrame, calendar: DataFrame | None, params: Params = Params()) -> DataFrame:
    return evidence.next_earnings(last, calendar, params.technical.event_risk_days)


def context(technical_outcomes: DataFrame, params: Params = Params()) -> DataFrame:
    return outcomes.historical_context(technical_outcomes, params.technical.min_history_samples)


def event_summary(found: DataFrame, params: Params = Params()) -> DataFrame:
    """The latest events of each ticker, as many as a summary shows."""
    return detection.recent_events(found, params.max_events_in_summary)


def technical_notes(frame: DataFrame) -> DataFrame:
    """Per ticker: sessions, filled sessions, and flags of a short history."""
    n = F.col("sessions")
    return (
        frame.groupBy("ticker")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if("filled_high_low").alias("filled_sessions"),
            F.max(F.struct("date", "swing_condition"))["swing_condition"].alias("condition"),
        )
        .withColumns(
            {
                "short_history": n < 250,
                "young_averages": n.between(250, 499),
                "unclassified": F.col("condition") == "n/a",
            }
        )
    )
