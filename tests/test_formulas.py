"""Formulas against loops, boundary tables, causality."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions import recurrence
from barlens.functions.frames import era
from barlens.functions.medians import exact_medians
from barlens.operators import cleaning, daily_stats, detection, evidence, indicators, labels, structure, summaries, swing
from barlens.params import EventParams, ParameterError, Params, StatisticsParams
from barlens.plans import flows
from barlens.vocab import STATES
from helpers import aged_ema_loop, column, ema_loop, walk, weekdays, wilder_loop


def test_recursive_averages_equal_loops(spark):
    bars = walk(spark, 2600).withColumn("era", era())
    holes = bars.withColumn("v", F.when(F.dayofmonth("date") % 7 != 0, F.col("volume")))
    out = recurrence.smooth(holes, {"e9": ("close", 9), "e250": ("close", 250)}, {"w14": ("v", 3)}).cache()
    close, v = column(out, "close"), column(out, "v")
    for name, expected in (("e9", ema_loop(close, 9)), ("e250", ema_loop(close, 250)), ("w14", wilder_loop(v, 3))):
        np.testing.assert_allclose(column(out, name), expected, rtol=1e-11)


@pytest.mark.parametrize("span", [2, 3, 5, 9, 26, 250])
def test_average_over_holes_equals_loop(spark, span):
    """Weights go by position: missing days, a missing start, a run of missing days longer than an era."""
    bars = walk(spark, 4200).withColumn("era", era())
    day = F.datediff("date", F.lit("1970-01-01"))
    gone = (F.dayofmonth("date") % 7 == 0) | (day % 97).between(20, 31) | (F.year("date") == 2012)
    first = bars.agg(F.min("date")).head()[0]
    gone = gone | (F.datediff("date", F.lit(first)) < 12) | F.datediff("date", F.lit(first)).between(1500, 3900)
    df = bars.withColumn("v", F.when(~gone, F.col("close")))
    out = recurrence.ema(df, {"e": ("v", span)}).cache()
    np.testing.assert_allclose(column(out, "e"), aged_ema_loop(column(out, "v"), span), rtol=1e-10)


def test_flat_closes_change_nothing(spark):
    """Changes of recursive averages are exactly 0 where closes stand still."""
    days = weekdays(120)
    rows = [("A", d, 10.0 + (i * 37 % 11) * (i < 100)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    df = df.select("*", *[F.col("close").alias(c) for c in ("open", "high", "low")], F.lit(1.0).alias("volume"))
    out = indicators.add_recursive(df.withColumn("era", era()))
    w = Window.partitionBy("ticker").orderBy("era", "date")
    moved = out.withColumn("moved", recurrence.apart(F.col("rsi6"), F.lag("rsi6", 3).over(w))).where(F.col("date") > days[104])
    assert {r.moved for r in moved.collect()} == {0.0}


@pytest.mark.parametrize("ranks", [{"p": ("v", 252, 126), "q": ("w", 126, 60)}, {"p": ("v", 7, 1)}, {"p": ("w", 30, 5)}])
def test_percentiles_equal_loop(spark, ranks):
    bars = walk(spark, 700).withColumn("era", era())
    v = F.when(F.dayofmonth("date") % 5 != 0, F.round("close", 0))
    df = bars.withColumns({"v": v, "w": F.col("volume")}).union(bars.limit(40).withColumns({"v": v, "w": F.col("volume")}).withColumn("ticker", F.lit("Z")))
    out = indicators.percentiles_of_previous(df, ranks)
    for ticker in ("Z", bars.head().ticker):
        one = out.where(F.col("ticker") == ticker).cache()
        for name, (source, window, least) in ranks.items():
            x = column(one, source)
            want = []
            for i, today in enumerate(x):
                earlier = x[max(0, i - window) : i]
                earlier = earlier[~np.isnan(earlier)]
                want.append(100 * (earlier <= today).mean() if not np.isnan(today) and len(earlier) >= least else np.nan)
            np.testing.assert_allclose(column(one, name), want)


def test_percentiles_gather_once_a_block(spark):
    """No frame of sessions is gathered: only frames of blocks, which move once a block."""
    bars = walk(spark, 60).withColumn("era", era())
    plan = indicators.percentiles_of_previous(bars, {"p": ("close", 252, 126)})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "specifiedwindowframe(RowFrame, -252" not in plan and "specifiedwindowframe(RangeFrame, -17, -1)" in plan


def test_rsi_extremes(spark):
    days = weekdays(40)
    rows = [("UP", d, 10.0 + i) for i, d in enumerate(days)] + [("FLAT", d, 5.0) for d in days]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    df = df.select("*", *[F.col("close").alias(c) for c in ("open", "high", "low")], F.lit(1.0).alias("volume"))
    out = indicators.add_recursive(df.withColumn("era", era()))
    last = {r.ticker: r.rsi6 for r in out.where(F.col("date") == days[-1]).collect()}
    assert last == {"UP": 100.0, "FLAT": 50.0}


def test_windows_need_full_history_and_exclude_today(spark):
    bars = walk(spark, 130)
    stats = flows.statistics(bars, None).cache()
    r, z = column(stats, "daily_return"), column(stats, "return_zscore")
    assert np.isnan(z[:61]).all() and not np.isnan(z[61:]).any()
    base = r[1:61]
    assert z[61] == pytest.approx((r[61] - base.mean()) / base.std(ddof=1), abs=1e-9)
    v, avg = column(stats, "volume"), column(stats, "avg_volume")
    assert avg[20] == pytest.approx(v[:20].mean())
    high, price = column(stats, "high"), column(stats, "price")
    mfe = column(stats, "mfe_3d")
    assert mfe[10] == pytest.approx(high[11:14].max() / price[10] - 1)
    assert np.isnan(mfe[-3:]).all() and not np.isnan(mfe[-4])


def test_future_does_not_change_the_past(spark):
    bars = walk(spark, 320)
    cut = weekdays(320)[259]
    names = ["ema50", "rsi6", "macd_hist", "adx", "bb_width_percentile", "obv_slope10"]
    whole = flows.technical(bars, None).where(F.col("date") <= cut).select("date", "trend", *names)
    early = flows.technical(bars.where(F.col("date") <= cut), None).select("date", "trend", *names)
    a, b = (sorted(map(tuple, d.collect())) for d in (whole, early))
    assert len(a) == 260
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        np.testing.assert_allclose(
            [np.nan if v is None else v for v in x[2:]], [np.nan if v is None else v for v in y[2:]], rtol=1e-12
        )


def test_repartition_changes_nothing(spark):
    bars = walk(spark, 200).unionByName(walk(spark, 200, seed=9, ticker="U"))
    a = flows.technical(bars, None).select("ticker", "date", "swing_score", "structure", "adx")
    b = flows.technical(bars.repartition(7, "volume"), None).select("ticker", "date", "swing_score", "structure", "adx")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_planted_events(spark):
    bars = walk(spark, 300, shocks={150: (0.15, 5), 200: (-0.12, 1), 250: (0.0005, 6)})
    found = {r.event_date: r for r in flows.events(flows.statistics(bars, None)).collect()}
    days = weekdays(300)
    both, price, volume = found[days[150]], found[days[200]], found[days[250]]
    assert (both.direction, both.trigger_rules) == ("up", "return_zscore,volume_ratio")
    assert price.direction == "down" and price.is_price_event
    assert volume.is_volume_event and not volume.is_price_event


def test_price_choice_is_all_or_nothing(spark):
    bars = walk(spark, 30).withColumn("adj_close", F.col("close") * 0.5)
    assert cleaning.choose_price_column(bars).where("price_column = 'adj_close'").count() == 30
    hole = bars.withColumn("adj_close", F.when(F.col("date") != weekdays(30)[4], F.col("adj_close")))
    assert cleaning.choose_price_column(hole).where("price_column = 'close' AND price = close").count() == 30


def test_exact_medians(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v), float(i)) for i, v in enumerate(rng.normal(0, 1, 2001))]
    rows += [("b", 5.0, None)] * 1500 + [("b", float(v), 1.0) for v in range(1000)] + [("c", 1.0, 2.0), ("c", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: (r.x, r.y) for r in exact_medians(df, ["k"], ["x", "y"]).collect()}
    for k in "abc":
        for i in (0, 1):
            values = [r[i + 1] for r in rows if r[0] == k and r[i + 1] is not None]
            assert got[k][i] == pytest.approx(float(np.median(values)), abs=0)


@pytest.mark.parametrize(
    "release,reaction,sessions,inside",
    [
        ("2026-09-29 16:05", "2026-09-30", 5, True),
        ("2026-09-24 07:00", "2026-09-24", 1, True),
        ("2026-09-23 16:30", "2026-09-24", 1, True),
        ("2026-09-26 10:00", "2026-09-28", 3, True),
        ("2026-10-02 09:00", "2026-10-02", 7, True),
        ("2026-10-02 16:00", "2026-10-05", 8, False),
    ],
)
def test_next_earnings(spark, release, reaction, sessions, inside):
    last = spark.createDataFrame([("T", dt.date(2026, 9, 23))], "ticker string, date date")
    releases = spark.sql(f"SELECT 'T' AS ticker, TIMESTAMP_NTZ '{release}:00' AS release_time")
    row = evidence.next_earnings(last, releases, 7).collect()[0]
    assert (str(row.reaction_date), row.sessions_until, row.within_window) == (reaction, sessions, inside)


def test_earlier_release_owns_its_sessions(spark):
    days = weekdays(6)  # 2020-01-01 is a Wednesday
    calendar = spark.createDataFrame([("T", d, i + 1) for i, d in enumerate(days)], "ticker string, date date, session long")
    releases = spark.sql(
        "SELECT * FROM VALUES ('T', TIMESTAMP_NTZ '2020-01-02 08:00:00', 1D, 1D, 1D),"
        " ('T', TIMESTAMP_NTZ '2020-01-02 17:00:00', 2D, 2D, 2D), ('T', TIMESTAMP_NTZ '2020-01-04 09:00:00', 3D, 3D, 3D)"
        " AS t(ticker, release_time, eps_estimate, reported_eps, surprise_pct)"
    )
    owned = evidence.earnings_windows(releases, calendar, 1).orderBy("session").collect()
    assert [(r.session, r.eps_estimate, r.offset) for r in owned] == [(2, 1.0, 0), (3, 1.0, 1), (4, 2.0, 1), (5, 3.0, 1)]


LABEL_ROW = dict(
    close=100.0, ema9=99.0, ema21=98.0, ema9_slope=0.01, ema21_slope=0.01, ema50=97.0, ema50_slope=0.01,
)


@pytest.mark.parametrize(
    "change,expected",
    [
        ({}, "Strong short-term uptrend"),
        ({"ema9_slope": -0.01}, "Short-term uptrend"),
        ({"ema21_slope": -0.01}, "Improving"),
        ({"close": 97.0, "ema9_slope": -0.01, "ema21_slope": -0.01}, "Deteriorating"),
        ({"close": 90.0, "ema9": 97.0, "ema9_slope": -0.01, "ema21_slope": -0.01}, "Strong short-term downtrend"),
        ({"close": 97.5, "ema9": 97.0, "ema9_slope": -0.01, "ema21_slope": -0.01}, "Short-term downtrend"),
        ({"close": 99.0, "ema21_slope": 0.0}, "Mixed"),
        ({"ema21": None}, "n/a"),
    ],
)
def test_trend_boundaries(spark, change, expected):
    row = LABEL_ROW | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    assert df.select(labels.label_trend()).collect()[0][0] == expected


def test_rsi_zone_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(80.0,), (79.99,), (30.0,), (29.99,), (None,)], "r double")
    got = [r[0] for r in df.select(labels.label_rsi_zone(F.col("r"))).collect()]
    assert got == ["Extremely strong / extended", "Strong momentum", "Weak momentum", "Oversold", "n/a"]


STATE_BASE = dict(
    close=100.0, atr=2.0, ema9=98.0, ema21=95.0, ema21_slope=0.01, ta_return_3d=0.01, ta_volume_ratio=1.0,
    rsi6=50.0, macd_hist=0.0, prior_high20=110.0, prior_low20=90.0, high20=110.0, low20=90.0,
    bb_width_percentile=50.0, adx=30.0,
)


@pytest.mark.parametrize(
    "change,state",
    [
        ({"close": 111.0, "ta_volume_ratio": 1.5}, "breakout_volume"),
        ({"close": 111.0, "ta_volume_ratio": 0.8}, "breakout_normal"),
        ({"close": 111.0, "ta_volume_ratio": 0.79}, "breakout_weak"),
        ({"close": 89.0, "ta_volume_ratio": 1.5}, "breakdown_volume"),
        ({"close": 89.0, "ta_volume_ratio": None}, "breakdown"),
        ({"close": 109.0}, "near_breakout"),
        ({"ema9": 99.0, "ta_return_3d": -0.01}, "pullback_ema9"),
        ({"ema9": 103.0, "ema21": 99.5, "ta_return_3d": -0.01}, "pullback_ema21"),
        ({"ema9": 104.0, "ema21": 97.0, "ta_return_3d": -0.01}, "pullback"),
        ({"ema9": 98.0, "ema21": 97.5}, "ema_compression"),
        ({"bb_width_percentile": 20.0}, "volatility_squeeze"),
        ({"high20": 103.0, "low20": 95.0, "adx": 19.0}, "range"),
        ({}, "bull_stack"),
        ({"ema9": 102.0, "ema21": 104.0}, "bear_stack"),
    ],
)
def test_structure_states(spark, change, state):
    """Four equal earlier days, then the day under test."""
    days = weekdays(5)
    base = {k: v for k, v in STATE_BASE.items()}
    rows = [("T", d, 2020, *(base | (change if i < 4 and not state.startswith("break") else {})).values()) for i, d in enumerate(days[:4])]
    rows.append(("T", days[4], 2020, *(base | change).values()))
    schema = "ticker string, date date, era int, " + ", ".join(f"{k} double" for k in base)
    last = structure.structure_states(spark.createDataFrame(rows, schema)).where(F.col("date") == days[4]).collect()[0]
    assert last[f"is_{state}"] and STATES[state] in last["states"]


def test_breakout_with_unknown_volume_is_nothing(spark):
    days = weekdays(2)
    base = STATE_BASE | {"close": 111.0, "ta_volume_ratio": None}
    schema = "ticker string, date date, era int, " + ", ".join(f"{k} double" for k in base)
    df = spark.createDataFrame([("T", d, 2020, *base.values()) for d in days], schema)
    row = structure.structure_states(df).collect()[0]
    assert not (row.is_breakout_volume or row.is_breakout_normal or row.is_breakout_weak)


def test_levels_merge_near_candidates(spark):
    """Planted pivots: two lows and two highs, one of each with a twin inside half an ATR."""
    days = weekdays(60)
    high = [101.0 + 0.001 * i for i in range(60)]
    low = [99.9 - 0.001 * i for i in range(60)]
    high[30], high[40], high[50] = 108.0, 108.6, 111.0
    low[25], low[45] = 96.0, 93.0
    rows = [("T", d, 2020, h, lo, 100.0, 2.0, 111.0, 93.0, 111.0, 93.0) for d, h, lo in zip(days, high, low)]
    names = ["high", "low", "close", "atr", "high20", "low20", "high60", "low60"]
    df = spark.createDataFrame(rows, "ticker string, date date, era int, " + ", ".join(f"{n} double" for n in names))
    got = {(r.side, r.level_no): r for r in structure.support_resistance(df).collect()}
    assert got["resistance", 1].price == 108.0 and got["resistance", 1].also_prices == [108.6]
    assert got["resistance", 2].price == 111.0 and got["resistance", 2].also == ["20D high", "60D high"]
    assert got["support", 1].price == 96.0 and got["support", 2].price == 93.0


def test_drawdown_dates(spark):
    prices = [100.0, 120.0, 120.0, 90.0, 90.0, 110.0, 121.0]
    days = weekdays(len(prices))
    rows = [("T", d, p) for d, p in zip(days, prices)]
    df = daily_stats.add_drawdown(spark.createDataFrame(rows, "ticker string, date date, price double"))
    row = summaries.max_drawdown(df).collect()[0]
    assert (row.drawdown_peak_date, row.trough_date, row.recovery_date) == (days[1], days[3], days[6])
    assert row.max_drawdown == pytest.approx(-0.25) and row.current_drawdown == 0


def test_benchmark_return_never_spans_a_missing_day(spark):
    stock = walk(spark, 120)
    bench = stock.withColumns({c: F.col(c) * 2 for c in ("close", "adj_close")}).where(F.col("date") != weekdays(120)[50])
    stats = flows.statistics(stock, bench)
    rb = column(stats, "benchmark_return")
    assert np.isnan(rb[[0, 50, 51]]).all() and np.isnan(rb).sum() == 3
    beta = summaries.beta_correlation(stats).collect()[0]
    assert beta.beta == pytest.approx(1.0) and beta.correlation == pytest.approx(1.0)


def test_parameters_are_checked():
    for bad in (
        lambda: StatisticsParams(zscore_window=4),
        lambda: EventParams(None, None, None, None),
        lambda: EventParams(return_zscore_threshold=-1),
        lambda: Params(period="3y"),
    ):
        with pytest.raises(ParameterError):
            bad()


def test_values_that_tie_with_a_threshold_reach_it(spark):
    """Each is the bound in exact arithmetic and misses it by rounding, as the 20-session volume score and the OBV slope can."""
    low = 2.4999999999999996
    flags = detection.rule_flags(EventParams(2.0, 1.8, 2.5, 0.03))["volume_zscore"]
    rows = spark.createDataFrame([(low,), (2.5,), (2.49999999,), (None,)], "volume_zscore double")
    assert [r[0] for r in rows.select(flags).collect()] == [True, True, False, False]
    slopes = [(0.09999999999999842,), (-0.09999999999999842,), (0.0999999,), (None,)]
    rows = spark.createDataFrame(slopes, "obv_slope10 double").select(
        "*", (-F.signum("obv_slope10") * 0.05).alias("ta_return_5d"), F.lit(1.5).alias("move_5d_atr")
    )
    assert [r[0] for r in rows.select(swing.obv_divergence()).collect()] == [True, True, False, False]


def test_last_row_uses_the_sort_that_is_there(spark):
    """Wide rows are sorted once; the row is the last by date, with and without eras."""
    bars = walk(spark, 1300, ticker="A").unionByName(walk(spark, 40, ticker="B"))
    wide = bars.withColumn("era", era()).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("era", "date")))
    out = summaries.last_row(wide)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {(r.ticker, r.n) for r in out.collect()} == {("A", 1300), ("B", 40)}
    assert {(r.ticker, r.date) for r in summaries.last_row(bars).collect()} == {(r.ticker, r.date) for r in out.collect()}
