"""Series over sessions: against loops, across tickers and batches, and how often they are dealt and sorted."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barlens.functions import series
from barlens.operators import earlier, indicators, labels, structure, summaries, swing
from barlens.params import Params
from barlens.plans import flows
from barlens.sources import derived
from helpers import column, walk, weekdays

STEPS = {
    "was": series.lag("v", 2),
    "next": series.lag("v", -2),
    "top": series.upto(series.highest, "close", 5),
    "bottom": series.after(series.lowest, "close", 3),
    "std": series.before(series.std_samp, "v", 4),
    "some": series.std_of_known("v", 6, 4),
    "sum": series.running_sum("close"),
}


def _expected(v, close):
    n, nan = len(v), np.nan
    known = [v[max(0, i - 6) : i][~np.isnan(v[max(0, i - 6) : i])] for i in range(n)]
    return {
        "was": [v[i - 2] if i >= 2 else nan for i in range(n)],
        "next": [v[i + 2] if i + 2 < n else nan for i in range(n)],
        "top": [close[i - 4 : i + 1].max() if i >= 4 else nan for i in range(n)],
        "bottom": [close[i + 1 : i + 4].min() if i + 3 < n else nan for i in range(n)],
        "std": [v[i - 4 : i].std(ddof=1) if i >= 4 else nan for i in range(n)],
        "some": [k.std(ddof=1) if len(k) >= 4 else nan for k in known],
        "sum": np.cumsum(close),
    }


@pytest.mark.parametrize("batch", [1, 37, 10_000])
def test_series_stay_inside_their_ticker(spark, batch):
    """Tickers of 1 to 90 sessions, cut anywhere by Arrow batches."""
    lengths = {"A": 90, "B": 1, "C": 3, "D": 40}
    bars = None
    for k, (ticker, n) in enumerate(lengths.items()):
        one = walk(spark, n, seed=k, ticker=ticker)
        bars = one if bars is None else bars.unionByName(one)
    bars = bars.withColumn("v", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = series.over_sessions(series.in_order(bars.coalesce(1)), STEPS).cache()
        for ticker, n in lengths.items():
            one = out.where(F.col("ticker") == ticker)
            v = column(one, "v")
            assert len(v) == n
            for name, want in _expected(v, column(one, "close")).items():
                np.testing.assert_allclose(column(one, name), want, rtol=1e-10, err_msg=f"{ticker} {name}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_values_have_no_spread(spark):
    flat = walk(spark, 70).withColumn("close", F.lit(0.1))
    out = series.over_sessions(series.in_order(flat), {"s": series.upto(series.std_pop, "close", 20), "k": series.std_of_known("close", 60, 40)})
    assert set(column(out, "s")[19:]) == {0.0} and set(column(out, "k")[60:]) == {0.0}


def test_indicators_are_dealt_and_sorted_once(spark):
    """Window steps copy every row and slide frame by frame: 2,976 s projected for 6 GB."""
    plan = indicators.compute_indicators(walk(spark, 60))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1 and plan.count("Repartition") == 1


def test_statistics_slide_no_window_and_indicators_use_the_order_there_is(spark):
    """1,848 to 2,568 s were projected for 6 GB: window steps of the statistics, a second deal of sorted bars."""
    bars, bench = walk(spark, 90), walk(spark, 90, seed=5, ticker="MKT")
    plan = flows.statistics(bars, bench, Params(benchmark="MKT"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(RowFrame, -" not in plan and "lag(" not in plan and "lead(" not in plan and "Sort [" not in plan
    assert plan.count("row_number()") == 1
    plan = flows.indicator_frame(bars, bench, Params(benchmark="MKT"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort [" not in plan and plan.count("row_number()") == 1


def test_peaks_and_starts(spark):
    """Equal peaks, unknown prices first and between, two tickers in one batch."""
    rows = [("A", 1, None, 2.0), ("A", 2, 5.0, None), ("A", 3, 4.0, 3.0), ("A", 4, 5.0, 4.0), ("A", 5, 6.0, None), ("A", 6, None, 1.0)]
    rows += [("B", 1, 1.0, 1.0), ("B", 2, 0.0, 2.0), ("B", 3, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "ticker string, d int, price double, b double")
    df = df.withColumn("date", F.date_from_unix_date("d")).withColumn("_day", F.col("d").cast("double"))
    steps = {
        "top": series.peak("price"), "day": series.at_peak("_day", "price"), "start": series.at_first("b", "price"),
        "begun": series.at_first("price", "b"), "g": series.growth("price"), "next": series.growth("price", -1), "g2": series.lag("g"),
    }
    out = series.over_sessions(series.numbered(df.coalesce(1)), steps).orderBy("ticker", "date")
    assert "_place" not in out.columns
    got = [tuple(r) for r in out.select(*steps).collect()]
    assert got == [
        (None, 1.0, None, None, None, None, None), (5.0, 2.0, None, None, None, -0.19999999999999996, None),
        (5.0, 2.0, 3.0, 4.0, -0.19999999999999996, 0.25, None), (5.0, 2.0, 3.0, 4.0, 0.25, 0.19999999999999996, -0.19999999999999996),
        (6.0, 5.0, 3.0, 4.0, 0.19999999999999996, None, 0.25), (6.0, 5.0, 3.0, 4.0, None, None, 0.19999999999999996),
        (1.0, 1.0, 1.0, 1.0, None, -1.0, None), (1.0, 1.0, 1.0, 1.0, -1.0, None, None), (2.0, 3.0, 1.0, 1.0, None, None, -1.0),
    ]


def test_functions_travel_with_the_query(tmp_path):
    """Executors do not have the package."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps(series.ema("close", 9)))
    load = "import pickle; print(pickle.load(open('f', 'rb')).column)"
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True)
    assert done.stdout == "close\n", done.stderr


def test_labels_read_the_series_of_earlier_sessions(spark):
    """No window deals the labelled rows again; a frame without the series gives the same; last sessions are those of all."""
    bars = walk(spark, 90)
    frame = indicators.compute_indicators(bars)
    together = indicators.compute_indicators(bars, earlier.EVERYTHING, earlier.inputs())

    def labelled(df):
        return swing.with_changes(labels.swing_condition(structure.structure_states(labels.classify_all(df))))

    quick = earlier.without(labelled(together))
    assert "Window" not in quick._jdf.queryExecution().optimizedPlan().toString()
    apart = labelled(frame)
    assert quick.columns == apart.columns
    key = ["ticker", "date"]
    assert quick.orderBy(key).collect() == apart.orderBy(key).collect()
    last = earlier.without(labelled(together.where("_sessions_left = 0")))
    assert last.orderBy(key).collect() == summaries.last_row(quick).orderBy(key).collect()


def test_slopes_that_tie_with_a_threshold_are_rounded_as_the_sql_does(spark):
    """Many slopes are 0.1 of the mean volume in exact arithmetic; the reading takes SQL's side of each."""
    rng = np.random.default_rng(4)
    n = 20_000
    volume, obv = np.full(n, 20.0), 7919.0 + np.cumsum(rng.integers(-30, 31, n))
    start = weekdays(1)[0]
    rows = [("A", start + dt.timedelta(days=i), float(o), float(v)) for i, (o, v) in enumerate(zip(obv, volume))]
    df = spark.createDataFrame(rows, "ticker string, date date, obv double, volume double")
    steps = {"slope": series.slope("obv", 10), "size": series.upto(series.mean, "volume", 10)}
    out = series.over_sessions(series.in_order(df), steps).withColumn("obv_slope10", F.col("slope") / F.col("size"))
    move = (-F.signum("obv_slope10")).alias("ta_return_5d")
    held = out.select("date", "obv_slope10", move, F.lit(1.5).alias("move_5d_atr")).where("obv_slope10 is not null")
    got = dict(held.select("date", swing.obv_divergence(slack=0)).collect())
    frame = pd.DataFrame({"pos": np.arange(1, n + 1), "obv": obv, "volume": volume})  # noqa: F841 - DuckDB reads it
    w = "(ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    want = duckdb.sql(f"SELECT pos, abs(regr_slope(obv, pos) OVER {w} / avg(volume) OVER {w}) AS s FROM frame QUALIFY count(*) OVER {w} = 10").fetchall()
    ties = [s for _, s in want if abs(s - 0.1) < 1e-12]
    assert len(ties) > 15 and {s >= 0.1 for s in ties} == {True, False}
    assert got == {start + dt.timedelta(days=p - 1): s >= 0.1 for p, s in want}


def test_only_what_a_query_rests_on_is_computed(spark):
    """1,200 s were not enough for 6 GB: every query took all series and carried 130 columns."""
    bars, bench = walk(spark, 90), walk(spark, 90, seed=5, ticker="MKT")
    params = Params(benchmark="MKT")
    plan = flows.taken(bars, bench, params, "rsi_zone")._jdf.queryExecution().optimizedPlan().toString()
    passes = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(passes) == 2 and all(line.split("run(")[1].split(")")[0].count("#") < 5 for line in passes)
    assert "ema9" not in plan
    wanted = ["rsi_zone", "band_state", "macd_details", "structure", "swing_condition", "fwd_abnormal_7d", "mfe_3d", "obv_slope10", "high60"]
    whole = flows.technical(bars, bench, params, with_outcomes=True, changes=True)
    whole = whole.withColumn("macd_details", swing.macd_event_details()).select("ticker", "date", *wanted).orderBy("date").collect()
    assert flows.taken(bars, bench, params, *wanted).select("ticker", "date", *wanted).orderBy("date").collect() == whole
    for c in wanted:
        one = flows.taken(bars, bench, params, c).orderBy("date").collect()
        assert [r[c] for r in one] == [r[c] for r in whole], c


def test_chart_and_levels_deal_the_recent_sessions_only(spark):
    """Windows over all sessions dealt and sorted them again, three times for the chart's limits."""
    frame = flows.taken(walk(spark, 200), None, Params(), *swing.CHART_SERIES, *structure.level_columns())
    for made in (swing.chart_window(frame), structure.level_candidates(frame)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number()") == 1 and "Sort [" not in plan and "Repartition" not in plan
        above = plan.split("MapInArrow")[0]
        assert "Window" not in above and "_sessions_left" in above


def test_context_leaves_its_task_as_one_row_a_ticker(spark):
    """Against loops over the sessions; the generated methods are short enough for Java to compile."""
    bars = walk(spark, 300).unionByName(walk(spark, 150, seed=8, ticker="U"))
    rows = flows.context_of(bars, None)
    technical = flows.technical(bars, None, with_outcomes=True)
    assert sorted(map(str, rows.collect())) == sorted(map(str, flows.context(technical).collect()))
    for ticker in "TU":
        days = technical.where(F.col("ticker") == ticker).orderBy("date").collect()
        today = days[-1]
        alike = {
            1: [today.structure in d.states for d in days],
            2: [(d.trend, d.rsi_zone) == (today.trend, today.rsi_zone) for d in days],
            3: [True] * len(days),
        }
        got = {(r.group_no, r.horizon): r for r in rows.where(F.col("ticker") == ticker).collect()}
        for k, like in alike.items():
            used = [a and d.fwd_return_7d is not None for a, d in zip(like, days)]
            x = np.array([d.fwd_return_3d for d, u in zip(days, used) if u])
            mae = np.array([d.mae_3d for d, u in zip(days, used) if u])
            r = got[k, 3]
            assert (r.n, r.episodes) == (sum(used), sum(u and not (i and used[i - 1]) for i, u in enumerate(used)))
            if r.n:
                want = (x.mean(), np.median(x), (x > 0).mean(), np.median(mae))
                np.testing.assert_allclose((r.avg, r.median, r.pct_positive, r.mae_median), want, rtol=1e-12)
    plan = flows.context_of(bars, bars, Params(benchmark="T"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            plan.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_bars_are_scanned_once_and_dealt_twice(spark):
    """The benchmark's copy of every day sum was dealt out once more with all the tickers' own."""
    made = derived.bars(spark, "/root/testdata/sf0.001")
    rows = made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1 and "Generate" not in plan
    days = {r.date for r in rows if r.ticker == derived.BENCHMARK}
    assert days == {r.date for r in rows if r.date.day != 13}
    total = {r.date: 0.0 for r in rows}
    for r in rows:
        total[r.date] += r.volume if r.ticker != derived.BENCHMARK else 0
    assert {r.date: r.volume for r in rows if r.ticker == derived.BENCHMARK} == {d: total[d] for d in days}
