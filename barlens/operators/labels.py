"""Descriptive labels of every session, as Column expressions over the indicator frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import before, era_sessions
from ..functions.nulls import all_of, at_least, every, first_match, missing, points, yes
from ..functions.recurrence import apart
from . import earlier
from ..vocab import (
    ADX,
    BAND,
    CONDITION,
    CONTEXT,
    CONTEXT_POINTS,
    EMA50,
    EMA50_POINTS,
    MACD,
    MACD_POINTS,
    MOMENTUM,
    NA,
    RSI_LOWEST,
    RSI_ZONES,
    STRENGTH,
    STRENGTH_POINTS,
    STRUCTURE_POINTS,
    TREND,
    TREND_POINTS,
    VOLATILITY_LEVELS,
    VOLATILITY_LOWEST,
    VOLUME_LEVELS,
    VOLUME_LOWEST,
    WIDTH,
)

CROSS_SESSIONS = 3
COMPONENTS = ("structure", "trend", "volume", "rsi", "macd", "boll", "relative_strength", "ema50")


def crossed(gap: Column, ends: tuple[Column, Column] | None = None, sessions: int = CROSS_SESSIONS) -> tuple[Column, Column]:
    """(crossed up, crossed down) within the last sessions and still on the new side.

    ``ends`` are the least and the greatest gap of the sessions before, where the frame has them.
    """
    recent = before(era_sessions(), sessions)
    lowest, highest = ends or (F.min(gap).over(recent), F.max(gap).over(recent))
    return every(gap > 0, lowest <= 0), every(gap < 0, highest >= 0)


def recent_cross(gap: Column, ends: tuple[Column, Column] | None = None, sessions: int = CROSS_SESSIONS) -> Column:
    up, down = crossed(gap, ends, sessions)
    return F.when(up, 1).when(down, -1).otherwise(0).cast("long")


def cross_age(gap: Column, ago: list[Column] | None = None, sessions: int = CROSS_SESSIONS) -> Column:
    """Sessions since the sign of the gap last changed; NULL if older or unclear.

    ``ago`` are the gaps of the sessions before, the latest first, where the frame has them.
    """
    ago = ago or [F.lag(gap, k + 1).over(era_sessions()) for k in range(sessions)]
    signs = [F.signum(g) for g in (gap, *ago)]
    clear = reduce(lambda a, b: a & b, [s.isNotNull() for s in signs]) & (signs[0] != 0)
    age = F.lit(None).cast("long")
    for k in reversed(range(sessions)):
        age = F.when(signs[k] != signs[k + 1], F.lit(k).cast("long")).otherwise(age)
    return F.when(clear, age)


def label_trend() -> Column:
    c, e9, e21 = F.col("close"), F.col("ema9"), F.col("ema21")
    s9, s21 = F.col("ema9_slope"), F.col("ema21_slope")
    rules = [
        (all_of(c > e9, e9 > e21, s9 > 0, s21 > 0), TREND.strong_up),
        (all_of(c < e9, e9 < e21, s9 < 0, s21 < 0), TREND.strong_down),
        (all_of(e9 > e21, c > e21, s21 > 0), TREND.up),
        (all_of(e9 < e21, c < e21, s21 < 0), TREND.down),
        (all_of(c > e9, s9 > 0), TREND.improving),
        (all_of(c < e9, s9 < 0), TREND.deteriorating),
    ]
    return first_match(
        rules, TREND.mixed, missing("close", "ema9", "ema21", "ema9_slope", "ema21_slope")
    )


def label_ema50() -> Column:
    c, e, s = F.col("close"), F.col("ema50"), F.col("ema50_slope")
    rules = [(all_of(c > e, s > 0), EMA50.up), (all_of(c < e, s < 0), EMA50.down)]
    return first_match(rules, EMA50.mixed, missing("close", "ema50", "ema50_slope"))


def label_rsi_zone(rsi: Column) -> Column:
    return at_least(rsi, RSI_ZONES, RSI_LOWEST, rsi.isNull())


def rsi_relationships() -> dict[str, Column]:
    r6 = F.col("rsi6")
    low, high = earlier.ends("rsi6")
    return {
        "rsi_cross": recent_cross(apart(r6, F.col("rsi14")), earlier.ends("_gap_rsi")),
        "rsi_recovering_oversold": every(low < 30, r6 >= low + 10),
        "rsi_losing_extended": every(high >= 80, r6 <= high - 10),
    }


def _hist_change(sessions: int) -> Column:
    return apart(F.col("macd_hist"), F.col(earlier.lagged("macd_hist", sessions)), F.col("close"))


def label_macd() -> Column:
    h, d1, d3 = F.col("macd_hist"), _hist_change(1), _hist_change(3)
    rules = [
        (all_of(d1 > 0, d3 > 0), MACD.improving),
        (all_of(d1 < 0, d3 < 0), MACD.weakening),
        (h >= 0, MACD.positive),
    ]
    return first_match(rules, MACD.negative, h.isNull() | d3.isNull())


def macd_details() -> dict[str, Column]:
    h, dif, change = F.col("macd_hist"), F.col("macd"), _hist_change(3)
    past = F.col(earlier.lagged("macd_hist", 3))
    same = F.signum(h) == F.signum(past)
    return {
        "macd_cross": recent_cross(h, earlier.ends("macd_hist")),
        "macd_hist_trend": first_match(
            [
                (all_of(same, change != 0, F.abs(h) > F.abs(past)), "expanding"),
                (all_of(same, change != 0, F.abs(h) < F.abs(past)), "contracting"),
            ],
            "",
        ),
        "macd_zero_context": first_match(
            [
                (all_of(dif < 0, change > 0), "below zero but improving"),
                (all_of(dif > 0, change < 0), "above zero but deteriorating"),
            ],
            "",
        ),
    }


def label_momentum() -> Column:
    returns = [f"ta_return_{n}d" for n in (2, 3, 5, 7)]
    rising = reduce(lambda a, b: a + b, [yes(F.col(r) > 0).cast("int") for r in returns])
    m5 = F.col("move_5d_atr")
    rules = [
        (all_of(rising == 4, m5 >= 1.5), MOMENTUM.strong_positive),
        (all_of(rising == 0, m5 <= -1.5), MOMENTUM.strong_negative),
        (all_of(rising >= 3, m5 > 0), MOMENTUM.positive),
        (all_of(rising <= 1, m5 < 0), MOMENTUM.negative),
    ]
    return first_match(rules, MOMENTUM.mixed, missing(*returns, "move_5d_atr"))


def label_volume() -> Column:
    r = F.col("ta_volume_ratio")
    return at_least(r, VOLUME_LEVELS, VOLUME_LOWEST, r.isNull())


def day_direction() -> Column:
    r = F.col("ta_return_1d")
    return first_match([(r > 0, "up"), (r < 0, "down")], "flat", r.isNull())


def label_vwap() -> Column:
    gap = F.try_divide(F.col("close") - F.col("vwap20"), "atr")
    return first_match([(gap > 0.5, "Above"), (gap < -0.5, "Below")], "Near", gap.isNull())


def label_bb_position() -> Column:
    b = F.col("bb_pct_b")
    rules = [
        (b > 1, BAND.above),
        (b >= 0.9, BAND.near_upper),
        (b > 0.6, BAND.upper_half),
        (b >= 0.4, BAND.middle),
        (b > 0.1, BAND.lower_half),
        (b >= 0, BAND.near_lower),
    ]
    return first_match(rules, BAND.below, b.isNull())


def label_band_state() -> Column:
    change, rank = F.col("bb_width_change"), F.col("bb_width_percentile")
    squeezed = F.col("_least_rank") <= 20
    rules = [
        (all_of(change >= 0.2, squeezed), WIDTH.after_squeeze),
        (change >= 0.2, WIDTH.expansion),
        (rank <= 20, WIDTH.squeeze),
        (change <= -0.15, WIDTH.contraction),
    ]
    return first_match(rules, WIDTH.stable, change.isNull() | rank.isNull())


def label_band_context() -> Column:
    b, c, e9, e21 = F.col("bb_pct_b"), F.col("close"), F.col("ema9"), F.col("ema21")
    s21, busy = F.col("ema21_slope"), F.col("ta_volume_ratio") >= 1.0

    rules = [
        (all_of(b >= 0.9, F.col("_upper_days") >= 3, c > e9, e9 > e21, s21 > 0), CONTEXT.upper_walk),
        (all_of(b <= 0.1, F.col("_lower_days") >= 3, c < e9, e9 < e21, s21 < 0), CONTEXT.lower_walk),
        (all_of(b > 1, e9 > e21, s21 > 0, busy), CONTEXT.upper_push),
        (b > 1, CONTEXT.upper_extension),
        (all_of(b < 0, e9 < e21, s21 < 0, busy), CONTEXT.lower_push),
        (b < 0, CONTEXT.lower_extension),
    ]
    return first_match(rules, CONTEXT.none, b.isNull())


def label_volatility() -> Column:
    rank = F.col("atr_pct_percentile")
    return at_least(rank, VOLATILITY_LEVELS, VOLATILITY_LOWEST, rank.isNull())


def relative_strength_score() -> Column:
    """Mean of the 5- and 7-session relative returns in units of their usual size."""
    sigma = F.when(F.col("rel_daily_sigma") > 0, F.col("rel_daily_sigma"))
    return (
        F.col("rel_5d") / (sigma * F.sqrt(F.lit(5.0))) + F.col("rel_7d") / (sigma * F.sqrt(F.lit(7.0)))
    ) / 2


def label_relative_strength(score: Column) -> Column:
    rules = [
        (score >= 1.25, STRENGTH.strong_out),
        (score >= 0.5, STRENGTH.out),
        (score > -0.5, STRENGTH.neutral),
        (score > -1.25, STRENGTH.under),
    ]
    return first_match(rules, STRENGTH.strong_under, score.isNull())


def label_adx() -> Column:
    x = F.col("adx")
    return first_match([(x >= 25, ADX.trending), (x < 20, ADX.weak)], ADX.borderline, x.isNull())


def labelling() -> series.Step:
    """Every label, over the indicators and the earlier sessions' series."""
    score = relative_strength_score()
    return {
        "trend": label_trend(),
        "ema50_state": label_ema50(),
        "rsi_zone": label_rsi_zone(F.col("rsi6")),
        **rsi_relationships(),
        "macd_state": label_macd(),
        **macd_details(),
        "momentum": label_momentum(),
        "volume_level": label_volume(),
        "day_direction": day_direction(),
        "vwap_position": label_vwap(),
        "bb_position": label_bb_position(),
        "band_state": label_band_state(),
        "band_context": label_band_context(),
        "volatility": label_volatility(),
        "relative_strength_score": score,
        "relative_strength": label_relative_strength(score),
        "adx_state": label_adx(),
    }


def classify_all(df: DataFrame) -> DataFrame:
    """Add every label in one projection over the earlier sessions' series."""
    return earlier.without(earlier.prepared(df, earlier.LABELS).withColumns(labelling()), df.columns)


def conditions() -> list[series.Step]:
    """The eight point columns, their sum and the condition (needs ``structure``)."""
    ratio, r6, r14 = F.col("ta_volume_ratio"), F.col("rsi6"), F.col("rsi14")
    size = first_match([(ratio >= 2.0, F.lit(2.0)), (ratio >= 1.5, F.lit(1.0))], F.lit(0.0))
    parts = {
        "structure": points(F.col("structure"), STRUCTURE_POINTS, 0),
        "trend": points(F.col("trend"), TREND_POINTS),
        "volume": size * F.coalesce(F.signum("ta_return_1d"), F.lit(0.0)),
        "rsi": first_match(
            [
                (all_of(r6 >= 60, r6 >= r14), F.lit(1.0)),
                (all_of(r6 < 40, r6 <= r14), F.lit(-1.0)),
            ],
            F.lit(0.0),
        ),
        "macd": points(F.col("macd_state"), MACD_POINTS),
        "boll": points(F.col("band_context"), CONTEXT_POINTS, 0),
        "relative_strength": points(F.col("relative_strength"), STRENGTH_POINTS, 0),
        "ema50": points(F.col("ema50_state"), EMA50_POINTS, 0),
    }
    unknown = (F.col("trend") == NA) | (F.col("macd_state") == NA) | r6.isNull()
    summed = reduce(lambda a, b: a + b, [F.col(f"points_{c}") for c in COMPONENTS])
    score = F.col("swing_score")
    up = F.col("trend").isin(TREND.strong_up, TREND.up)
    down = F.col("trend").isin(TREND.strong_down, TREND.down)
    rules = [
        (all_of(score >= 6, up), CONDITION.strong),
        (all_of(score <= -6, down), CONDITION.weak),
        (score >= 2, CONDITION.improving),
        (score <= -2, CONDITION.weakening),
    ]
    return [
        {f"points_{c}": F.when(~unknown, parts[c]) for c in COMPONENTS},
        {"swing_score": summed + F.lit(0.0)},
        {"swing_condition": first_match(rules, CONDITION.mixed, unknown)},
    ]


def swing_condition(df: DataFrame) -> DataFrame:
    """Add the eight point columns, their sum and the condition (needs ``structure``)."""
    return reduce(lambda out, step: out.withColumns(step), conditions(), df)
