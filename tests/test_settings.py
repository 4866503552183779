"""Settings take effect, recurrences hold for any span, medians keep a small last cell."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from barlens.functions import recurrence
from barlens.functions.frames import era
from barlens.functions import medians
from barlens.functions.medians import exact_medians
from barlens.operators import relative, summaries
from barlens.params import Params, TechnicalParams
from barlens.plans import flows
from barlens.sources.bars import standardize_prices
from barlens.sources.releases import earnings_scan
from barlens.sources.sinks import analysis_documents
from helpers import walk


def _series(spark, values):
    start = dt.date(1990, 1, 1)
    rows = [("T", start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, x double").withColumn("era", era())


def test_averages_of_any_span_over_twelve_years(spark):
    rnd = random.Random(1)
    values = [100 + rnd.gauss(0, 5) for _ in range(4400)]
    spans, periods = (2, 3, 5, 9, 250), (2, 3, 14)
    df = recurrence.ema(_series(spark, values), {f"e{s}": ("x", s) for s in spans})
    df = recurrence.wilder(df, {f"w{p}": ("x", p) for p in periods})
    got = df.orderBy("date").collect()
    for s in spans:
        y = None
        for i, v in enumerate(values):
            y = v if y is None else y + 2 / (s + 1) * (v - y)
            assert got[i][f"e{s}"] is None if i < s - 1 else got[i][f"e{s}"] == pytest.approx(y, rel=1e-9)
    for p in periods:
        y = plain.fmean(values[:p])
        for i in range(p - 1, len(values)):
            y = y if i == p - 1 else y + (values[i] - y) / p
            assert got[i][f"w{p}"] == pytest.approx(y, rel=1e-9)


def test_a_hole_ages_emas_and_pauses_wilder(spark):
    values = [1.0, 2.0, 4.0, None, 8.0, 3.0]
    df = _series(spark, values)
    a = 2 / 3
    second = a * 2 + (1 - a)
    third = a * 4 + (1 - a) * second
    fifth = (a * 8 + (1 - a) ** 2 * third) / (a + (1 - a) ** 2)
    got = [r.e for r in recurrence.ema(df, {"e": ("x", 2)}).orderBy("date").collect()]
    assert got == pytest.approx([None, second, third, third, fifth, a * 3 + (1 - a) * fifth])
    got = [r.w for r in recurrence.wilder(df, {"w": ("x", 2)}).orderBy("date").collect()]
    assert got == [None, 1.5, 2.75, 2.75, 5.375, 4.1875]


def test_median_cells_follow_ranks_not_widths(spark, monkeypatch):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("k"), F.when(F.col("id") == 0, 1e9).when(F.col("id") == 1, 1e4).otherwise(F.sin("id")).alias("x"))
    values = sorted([1e9, 1e4] + [math.sin(i) for i in range(2, n)])
    monkeypatch.setattr(medians, "RANKED", 50)  # what was kept is cut again, twice
    got = exact_medians(df, ["k"], ["x"], [F.count("*").alias("rows")])
    assert got.head().rows == n and got.head().x == pytest.approx((values[n // 2 - 1] + values[n // 2]) / 2, abs=1e-12)


def test_period_cuts_history(spark):
    bars = walk(spark, 1500) if callable(walk) else None
    whole = flows.statistics(bars, None, Params(period="max")).count()
    year = flows.statistics(bars, None, Params(period="1y"))
    assert year.count() < whole and year.agg(F.datediff(F.max("date"), F.min("date"))).head()[0] <= 366


def test_repeated_benchmark_day_multiplies_nothing(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("A", day, 1.0)], "ticker string, date date, price double")
    bench = spark.createDataFrame([(day, 5.0), (day, 5.0)], "date date, price double")
    assert relative.align_benchmark(df, bench).count() == 1


def test_rule_switched_off_has_no_tail(spark):
    stats = spark.createDataFrame([("A", 3.0)], "ticker string, return_zscore double")
    assert summaries.tail_frequency(stats, None).count() == 0 and summaries.tail_frequency(stats, 2.5).count() == 1


def test_first_copy_of_a_release_stays(spark):
    rows = [("A", "2020-01-01 09:00:00", 2.0, 1), ("A", "2020-01-01 09:00:00", 9.0, 2)]
    raw = spark.createDataFrame(rows, ["ticker", "Earnings Date", "EPS Estimate", "ingest_seq"])
    assert [r.eps_estimate for r in earnings_scan(raw).collect()] == [2.0]


def test_whole_text_must_be_a_date(spark):
    texts = ["2020-01-01", "2020-01-01junk", "01/02/2020", "1/2/2020", "2020-01-01 00:00:00-05:00", "2020-13-01", None]
    raw = spark.createDataFrame([("A", t, "1") for t in texts], "ticker string, Date string, Close string")
    got = sorted(str(r.date) for r in standardize_prices(raw).collect())
    assert got == ["2020-01-01", "2020-01-01", "2020-01-02", "2020-01-02"]


def test_technical_settings_take_effect(spark):
    bars = walk(spark, 320, shocks={40: (0.1, 6), 150: (-0.1, 6), 200: (0.12, 6), 260: (-0.09, 6)})
    tight = Params(
        period="max", max_events_in_summary=2,
        technical=TechnicalParams(chart_days=20, structure_lookback_days=20, pivot_bars=1, event_risk_days=1, min_history_samples=1000),
    )
    usual = Params(period="max")
    technical = flows.technical(bars, None, with_outcomes=True).cache()
    assert (flows.chart(technical, tight).count(), flows.chart(technical, usual).count()) == (20, 126)
    found = flows.events(flows.statistics(bars, None, usual), usual)
    assert flows.event_summary(found, tight).count() == 2 < flows.event_summary(found, usual).count()
    near = [{(r.side, r.price, r.origin) for r in flows.levels(technical, p).collect()} for p in (tight, usual)]
    assert near[0] and near[0] != near[1]
    assert {r.small_sample for r in flows.context(technical, tight).collect()} == {True}
    assert not all(r.small_sample for r in flows.context(technical, usual).collect())
    last = summaries.last_row(bars)
    release = last.select("ticker", (F.date_add("date", 5).cast("timestamp_ntz")).alias("release_time"))
    risk = [flows.event_risk(last, release, p).head().within_window for p in (tight, usual)]
    assert risk == [False, True]


def test_a_ticker_of_one_section_has_its_document(spark):
    a = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "ticker string, x double")
    b = spark.createDataFrame([("B", dt.date(2020, 1, 1))], "ticker string, day date")
    got = {r.ticker: r for r in analysis_documents({"a": a, "b": b}).collect()}
    assert [x.x for x in got["A"].a] == [1.0, 2.0] and got["A"].b is None
    assert got["B"].a is None and [x.day for x in got["B"].b] == ["2020-01-01"]
