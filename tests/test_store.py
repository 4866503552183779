"""Merges, imports, cleaning, sources."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlens.operators import cleaning, fundamentals, merge
from barlens.params import EventParams, Params
from barlens.plans import flows
from barlens.sources import bars as bar_sources
from barlens.sources import store
from barlens.vocab import EVENT_COLUMNS
from helpers import BARS, walk, weekdays

SOURCE = ("calendar",)


@pytest.fixture(scope="module")
def found(spark):
    bars = walk(spark, 260, shocks={150: (0.15, 5), 200: (-0.12, 4)})
    return flows.events(flows.statistics(bars, bars)).drop("session").cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_merge_is_idempotent_and_keyed(spark, found):
    once = merge.merge_events(found, found, SOURCE)
    assert rows(once) == rows(found)
    assert once.select("ticker", "event_date").distinct().count() == once.count()


def test_merge_protects_research_and_outcomes(spark, found):
    manual = found.withColumns(
        {"event_category": F.lit("Product"), "verification_status": F.lit("Researched manually"), "notes": F.lit("mine")}
    )
    evidence = found.withColumns(
        {
            "event_category": F.lit("Earnings release (date match)"),
            "source": F.lit("calendar"),
            "verification_status": F.lit("Unverified (automatic date match)"),
            "notes": F.lit("other"),
            "fwd_return_20d": F.lit(None).cast("double"),
            "benchmark": F.lit(None).cast("string"),
            "benchmark_return": F.lit(None).cast("double"),
        }
    )
    kept = merge.merge_events(manual, evidence, SOURCE)
    assert {(r.event_category, r.notes) for r in kept.collect()} == {("Product", "mine")}
    assert kept.where("fwd_return_20d IS NOT NULL").count() == found.where("fwd_return_20d IS NOT NULL").count()
    filled = merge.merge_events(found, evidence, SOURCE)
    assert {r.source for r in filled.collect()} == {"calendar"}
    # evidence is not replaced by "Unknown", benchmark figures survive a run without one
    again = merge.merge_events(filled, found, SOURCE)
    assert {r.source for r in again.collect()} == {"calendar"}
    assert filled.where("benchmark_return IS NOT NULL").count() == found.where("benchmark_return IS NOT NULL").count()


def test_import_research_twice_changes_nothing_more(spark, found):
    day = found.orderBy("event_date").first().event_date
    edited = spark.createDataFrame(
        [("t ", str(day), " News ", "", "", "Unverified", None), ("T", "1990-01-01", "x", "", "", "", "")],
        "ticker string, event_date string, event_category string, event_description string, source string,"
        " verification_status string, notes string",
    )
    counts = merge.import_counts(edited, found).collect()[0]
    assert (counts.updated_events, counts.status_set_manual, counts.unmatched) == (1, 1, 1)
    after = merge.import_research(edited, found)
    row = after.where(F.col("event_date") == day).collect()[0]
    assert (row.event_category, row.verification_status) == ("News", "Researched manually")
    assert merge.import_changes(edited, after).count() == 0
    assert rows(merge.import_research(edited, after)) == rows(after)


def test_refresh_fills_unknown_outcomes_only(spark, found):
    old = found.withColumns({"fwd_return_20d": F.lit(None).cast("double"), "fwd_abnormal_1d": F.lit(9.0)})
    bars = walk(spark, 260, shocks={150: (0.15, 5), 200: (-0.12, 4)})
    stats = flows.statistics(bars, bars)
    fresh = merge.refresh_outcomes(old, stats, None)
    assert fresh.where("fwd_return_20d IS NOT NULL").count() > 0
    assert fresh.where("fwd_abnormal_1d = 9").count() == found.count()


def test_older_tables_get_missing_columns(found):
    older = found.drop("mfe_3d", "fwd_return_7d")
    assert set(merge.evolve_events_schema(older).columns) == set(EVENT_COLUMNS)


def test_db_values(spark):
    df = spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b, true AS c, DATE '2020-01-02' AS d, 1.5D AS e")
    assert tuple(merge.db_values(df).collect()[0]) == (None, None, 1, "2020-01-02", 1.5)


def test_cleaning_counts(spark):
    d = weekdays(6)
    raw = [
        ("T", d[0], 1.0, 2.0, 1.0, 1.5, 1.5, 10.0, 1),
        ("T", d[0], 1.0, 2.0, 1.0, 1.6, 1.5, 10.0, 2),
        ("T", d[1], 1.0, 2.0, 1.0, None, 1.5, 10.0, 1),
        ("T", d[2], 1.0, 2.0, 1.0, -1.0, 1.5, 10.0, 1),
        ("T", d[3], 1.0, 2.0, 1.0, 1.5, 1.5, -10.0, 1),
        ("T", d[4], 1.0, 2.0, 1.0, 2.5, 1.5, 0.0, 1),
        ("T", d[5] + dt.timedelta(days=30), 1.0, 2.0, 1.0, 1.5, 1.5, None, 1),
    ]
    df = spark.createDataFrame(raw, BARS + ", ingest_seq long")
    r = cleaning.quality_report(df).collect()[0]
    assert (r.duplicate_rows, r.bad_close_rows, r.usable_rows) == (1, 2, 4)
    assert (r.negative_volume_days, r.missing_volume_days, r.zero_volume_days, r.inconsistent_ohlc_days) == (1, 2, 1, 1)
    clean = cleaning.clean_prices(df)
    assert clean.count() == 4 and clean.where("close = 1.6").count() == 1
    assert cleaning.long_gaps(clean).collect()[0].long_gaps == 1
    assert cleaning.clean_prices(df.limit(1)).count() == 0


def test_csv_layouts(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('Date,Close/Last,Volume,Open,High,Low\n01/15/2020,$101.50,"1,200,000",$100.00,$102.00,$99.00\n')
        f.write("not a date,$1,1,1,1,1\n01/14/2020,n/a,5,1,1,1\n")
    got = {str(r.date): r for r in bar_sources.read_prices_csv(spark, path, keep=()).collect()}
    assert set(got) == {"2020-01-15", "2020-01-14"}
    row = got["2020-01-15"]
    assert (row.close, row.volume, row.adj_close) == (101.5, 1200000.0, None)
    assert got["2020-01-14"].close is None
    with pytest.raises(bar_sources.DataUnavailable):
        bar_sources.standardize_prices(spark.sql("SELECT 1 AS open, DATE '2020-01-01' AS date"), keep=())


def test_growth_skips_a_missing_year(spark):
    years = {2020: 100.0, 2021: 110.0, 2023: 150.0}
    annual = spark.createDataFrame(
        [("T", dt.date(y, 12, 31), m, v * f) for y, v in years.items() for m, f in (("revenue", 1.0), ("net_income", 0.1))],
        "ticker string, period_end date, metric string, value double",
    )
    got = fundamentals.calculated_ratios(annual, dt.date(2024, 1, 1), "p").where("metric = 'revenue_growth'").collect()
    assert [(r.period_end.year, round(r.value, 6)) for r in got] == [(2021, 0.1)]


def test_event_study_in_one_pass_equals_two(spark):
    from barlens.operators import outcomes

    bars = walk(spark, 300, shocks={150: (0.15, 5), 200: (-0.12, 4)})
    params = Params(events=EventParams(2.0, 1.5))
    stats = flows.statistics(bars, None, params)
    two = outcomes.event_outcomes(flows.events(stats, params), stats)
    one = flows.event_study(bars, None, params)
    names = ["ticker", "group", "n_events", "n_7d", "median_5d", "mean_mfe_3d"]
    assert sorted(map(str, one.select(*names).collect())) == sorted(map(str, two.select(*names).collect()))


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


@pytest.fixture()
def kept(spark, tmp_path):
    bars = walk(spark, 600, ticker="AA")
    for n, ticker in enumerate(("BB", "CC", "DD")):
        bars = bars.union(walk(spark, 600, seed=n, ticker=ticker))
    store.write_table(bars, str(tmp_path / "bars"), ["ticker", "date"], "date", buckets=4)
    return bars, tmp_path / "bars"


def test_scans_read_only_the_folders_of_their_tickers_and_days(spark, kept):
    bars, path = kept
    some = store.scan_table(spark, str(path), ["BB"], "2021-02-01", "2021-03-31", "date", buckets=4)
    want = bars.where("ticker = 'BB' AND date BETWEEN '2021-02-01' AND '2021-03-31'")
    assert rows(some) == rows(want) and some.columns == bars.columns
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "bucket" in filters[0] and "year" in filters[0] and "ticker" in filters[1]
    executed = some._jdf.queryExecution().executedPlan()
    executed.executeCollect()
    scan = executed.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1 < len(_files(path))


def test_merges_rewrite_only_the_folders_they_touch(spark, kept):
    bars, path = kept
    before = _files(path)
    batch = bars.where("ticker = 'CC' AND date >= '2021-12-20' AND date < '2022-01-10'").withColumn("close", F.lit(1.0))
    batch = batch.union(batch.limit(1).withColumn("date", F.lit("2035-01-01").cast("date")))
    folders = store.merge_table(spark, str(path), batch, merge.merge_prices, ["ticker", "date"], "date", buckets=4)
    assert folders == 3
    after = _files(path)
    gone = {f.rsplit("/", 1)[0] for f in before.keys() - after.keys()}
    assert len(gone) == 2 and all("year=2021" in f or "year=2022" in f for f in gone)
    same = before.keys() & after.keys()
    assert len(same) == len(before) - 2 and all(before[f] == after[f] for f in same)
    assert rows(store.read_table(spark, str(path))) == rows(merge.merge_prices(bars, batch))
    assert store.merge_table(spark, str(path), batch.limit(0), merge.merge_prices, ["ticker", "date"], "date", buckets=4) == 0


def test_edited_rows_apply_in_file_order(spark, found, tmp_path):
    """Three rows of one event: of each field the last cell stays, whatever its text; a manual status is kept."""
    days = [str(r.event_date) for r in found.orderBy("event_date").collect()]
    header = "ticker,event_date,event_category,event_description,source,verification_status,notes\n"
    first = [("T", days[0], "Zeta", "one", "z", "Checked by hand", "n1"), ("T", days[0], "Alpha", "", "", "Unverified", ""), ("T", days[0], "Beta", "", "a", "", "")]
    (tmp_path / "a.csv").write_text(header + "".join(",".join(r) + "\n" for r in first))
    (tmp_path / "b.csv").write_text(header + f"T,{days[1]},,,,Unverified,only notes\nT,{days[1]},Late news,,,,\n")
    edited = merge.read_edits(spark, str(tmp_path)).repartition(7)
    after = {str(r.event_date): r for r in merge.import_research(edited, found).collect()}
    a, b = after[days[0]], after[days[1]]
    assert (a.event_category, a.event_description, a.source, a.verification_status, a.notes) == ("Beta", "one", "a", "Checked by hand", "n1")
    assert (b.event_category, b.verification_status, b.notes) == ("Late news", "Researched manually", "only notes")
