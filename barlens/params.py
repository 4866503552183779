"""Settings of an analysis run, checked when they are built."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Calendar length in days of each named history period.
PERIOD_DAYS = {"1y": 366, "2y": 731, "5y": 1827, "10y": 3653}
PERIODS = (*PERIOD_DAYS, "ytd", "max")


class ParameterError(ValueError):
    """A setting is missing or outside its range."""


def _whole(name: str, value, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ParameterError(f"{name} must be a whole number >= {least}, got {value!r}")


@dataclass(frozen=True)
class StatisticsParams:
    zscore_window: int = 60
    volume_window: int = 20
    volatility_window: int = 20
    trading_days_per_year: int = 252

    def __post_init__(self):
        for name in ("zscore_window", "volume_window", "volatility_window"):
            _whole(name, getattr(self, name), 5)
        _whole("trading_days_per_year", self.trading_days_per_year, 1)


@dataclass(frozen=True)
class EventParams:
    """Thresholds of the event rules; ``None`` switches a rule off."""

    return_zscore_threshold: float | None = 2.5
    volume_ratio_threshold: float | None = 2.0
    volume_zscore_threshold: float | None = None
    abs_return_threshold: float | None = None
    earnings_match_window_days: int = 1

    def __post_init__(self):
        thresholds = {
            name: value for name, value in asdict(self).items() if name.endswith("_threshold")
        }
        for name, value in thresholds.items():
            if value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
                raise ParameterError(f"{name} must be a positive number or None, got {value!r}")
        if all(value is None for value in thresholds.values()):
            raise ParameterError("at least one event rule must be enabled")
        _whole("earnings_match_window_days", self.earnings_match_window_days, 0)


@dataclass(frozen=True)
class TechnicalParams:
    chart_days: int = 126
    structure_lookback_days: int = 60
    pivot_bars: int = 3
    event_risk_days: int = 7
    min_history_samples: int = 20

    def __post_init__(self):
        _whole("chart_days", self.chart_days, 20)
        _whole("structure_lookback_days", self.structure_lookback_days, 20)
        _whole("pivot_bars", self.pivot_bars, 1)
        _whole("event_risk_days", self.event_risk_days, 1)
        _whole("min_history_samples", self.min_history_samples, 1)


@dataclass(frozen=True)
class Params:
    period: str = "5y"
    benchmark: str | None = None
    max_events_in_summary: int = 30
    statistics: StatisticsParams = field(default_factory=StatisticsParams)
    events: EventParams = field(default_factory=EventParams)
    technical: TechnicalParams = field(default_factory=TechnicalParams)

    def __post_init__(self):
        if self.period not in PERIODS:
            raise ParameterError(f"period must be one of {PERIODS}, got {self.period!r}")
        _whole("max_events_in_summary", self.max_events_in_summary, 1)
