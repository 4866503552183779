"""One registered query per operator, each over the whole provided tables.

Results are made comparable across engines: doubles are rounded, dates are ISO text,
lists are joined with "|".
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import recurrence
from ..functions.frames import era, era_sessions
from ..functions.nulls import number
from ..operators import cleaning, daily_stats, detection, evidence, fundamentals, indicators, labels
from ..operators import merge, outcomes, relative, structure, summaries, swing
from ..params import EventParams, Params
from ..sources import bars as bar_sources
from ..sources import derived, releases, sinks, store
from ..vocab import EVENT_COLUMNS, OUTCOMES, RESEARCH_FIELDS, STATES, STOCK_FIELDS
from . import flows

CALENDAR_SOURCE = "provider earnings calendar"
PROVIDER = "provider"
RETRIEVED = date(2002, 1, 31)
RUN_DATE = date(2001, 11, 10)
OLD_CUT = "2000-12-31"


def shown(df: DataFrame, digits: int = 8) -> DataFrame:
    """Comparable values only."""

    def value(field: T.StructField) -> str:
        name, kind = f"`{field.name}`", field.dataType
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        text = name
        if isinstance(kind, T.DoubleType):
            text = f"round({name}, {digits}) + 0D"
        elif isinstance(kind, T.DateType):
            text = f"date_format({name}, 'yyyy-MM-dd')"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = f"date_format({name}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(element, T.StringType):
            text = f"concat_ws('|', {name})"
        elif isinstance(element, T.DateType):
            text = f"concat_ws('|', transform({name}, d -> date_format(d, 'yyyy-MM-dd')))"
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            text = f"CAST({name} AS BIGINT)"
        return f"{text} AS {name}"

    return df.selectExpr(*[value(f) for f in df.schema])


#: Ticker buckets of the tables that queries store; few, as the fixtures are small.
FOLDERS = 4


class Inputs:
    """The frames the queries start from, declared once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.params = Params(period="max", benchmark=derived.BENCHMARK)

    @cached_property
    def all_bars(self) -> DataFrame:
        """The price store: one row per ticker and day.

        Tickers and benchmark both come from it, so it is kept (lineage stays, a lost
        block is recomputed) instead of scanning the line items once per use.
        """
        return derived.bars(self.spark, self.sf_dir).persist()

    @cached_property
    def bars(self) -> DataFrame:
        return derived.stocks(self.all_bars)

    @cached_property
    def benchmark(self) -> DataFrame:
        return derived.benchmark(self.all_bars)

    @cached_property
    def old_bars(self) -> DataFrame:
        """History as it was known at the end of 2000."""
        return self.bars.where(F.col("date") <= F.lit(OLD_CUT).cast("date"))

    @cached_property
    def old_benchmark(self) -> DataFrame:
        return self.benchmark.where(F.col("date") <= F.lit(OLD_CUT).cast("date"))

    @cached_property
    def dirty(self) -> DataFrame:
        return derived.dirty_bars(self.bars)

    @cached_property
    def priced(self) -> DataFrame:
        return cleaning.choose_price_column(self.bars)

    @cached_property
    def plain(self) -> DataFrame:
        """Statistics without a benchmark."""
        return flows.statistics(self.bars, None, self.params)

    @cached_property
    def stats(self) -> DataFrame:
        return flows.statistics(self.bars, self.benchmark, self.params)

    @cached_property
    def old_stats(self) -> DataFrame:
        return flows.statistics(self.old_bars, self.old_benchmark, self.params)

    @cached_property
    def releases(self) -> DataFrame:
        return releases.earnings_scan(derived.earnings_raw(self.spark, self.sf_dir))

    @cached_property
    def flagged(self) -> DataFrame:
        return detection.flag_sessions(self.stats, self.params.events)

    @cached_property
    def found(self) -> DataFrame:
        """Events before evidence."""
        return flows.events(self.stats, self.params)

    @cached_property
    def events(self) -> DataFrame:
        return flows.events(self.stats, self.params, self.releases, CALENDAR_SOURCE)

    @cached_property
    def stored(self) -> DataFrame:
        """Events stored at the end of 2000, some of them researched by hand."""
        old = flows.events(self.old_stats, self.params).drop("session")
        edited = F.dayofmonth("event_date") % 10 == 3
        return old.withColumns(
            {
                "event_category": F.when(edited, "Product news").otherwise(F.col("event_category")),
                "verification_status": F.when(edited, "Researched manually").otherwise(
                    F.col("verification_status")
                ),
                "notes": F.when(edited, "checked").otherwise(F.col("notes")),
            }
        )

    def taken(self, *wanted: str) -> DataFrame:
        """These indicators, labels, states, readings or outcomes of every session."""
        return flows.taken(self.bars, self.benchmark, self.params, *wanted)

    def last(self, *wanted: str) -> DataFrame:
        """The same of the tickers' last sessions."""
        return flows.last_of(self.bars, self.benchmark, self.params, *wanted)

    def recent(self, *wanted: str) -> DataFrame:
        """The same of the sessions that charts show and levels look back on."""
        sessions = max(self.params.technical.chart_days, self.params.technical.structure_lookback_days)
        return swing.recent(self.taken(*wanted, "_sessions_left"), sessions)

    @cached_property
    def adjusted(self) -> DataFrame:
        return indicators.adjust_ohlcv(self.priced).withColumn("era", era())

    @cached_property
    def info(self) -> DataFrame:
        return derived.company_info(self.spark, self.sf_dir)

    @cached_property
    def wide_statements(self) -> DataFrame:
        return derived.statements_wide(self.spark, self.sf_dir)

    @cached_property
    def statements(self) -> DataFrame:
        return fundamentals.statements_unpivot(self.wide_statements)

    @cached_property
    def annual(self) -> DataFrame:
        who = fundamentals.profile(self.info)
        return fundamentals.annual_fundamentals(self.statements, who, RETRIEVED, PROVIDER)

    @cached_property
    def fundamentals(self) -> DataFrame:
        return fundamentals.collect_fundamentals(self.info, self.statements, RETRIEVED, PROVIDER)

    @cached_property
    def stored_fundamentals(self) -> DataFrame:
        """What earlier runs stored: figures up to 2000, two snapshot retrievals."""
        rows = self.fundamentals.drop("label")
        annual = rows.where(
            (F.col("period_type") == "annual") & (F.col("period_end") <= F.lit(OLD_CUT).cast("date"))
        )
        snaps = rows.where(F.col("period_type") == "snapshot")
        for day, factor in (("2000-06-30", 0.8), (OLD_CUT, 0.9)):
            stamp = F.lit(day).cast("date")
            annual = annual.unionByName(
                snaps.withColumns(
                    {"period_end": stamp, "retrieved_at": stamp, "value": F.round(F.col("value") * factor, 2)}
                )
            )
        return annual

    @cached_property
    def stored_stocks(self) -> DataFrame:
        """Profiles as stored earlier, without sector and for all but one ticker."""
        who = fundamentals.profile(self.info).where(F.col("ticker") != "AF")
        return who.select(
            "ticker",
            *[
                F.lit("Ruritania").alias(c) if c == "country"
                else F.lit(None).cast("string").alias(c) if c == "sector"
                else F.concat(F.lit("Old "), F.col(c)).alias(c) if c == "name"
                else F.col(c)
                for c in STOCK_FIELDS
            ],
            F.lit("2000-12-31T00:00:00").alias("first_analyzed"),
            F.lit("2000-12-31T00:00:00").alias("last_analyzed"),
        )

    @cached_property
    def price_store(self) -> DataFrame:
        """Stored bars with the time they were saved."""
        return self.bars.withColumns(
            {"source": F.lit(PROVIDER), "updated_at": F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T18:00:00"))}
        )

    @cached_property
    def edited(self) -> DataFrame:
        """A research file: text cells, blanks for "no change", one unknown key."""
        day = F.dayofmonth("event_date")
        rows = self.stored.select(
            F.lower("ticker").alias("ticker"),
            F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
            F.col("close").cast("string").alias("close"),
            F.when(day % 4 == 0, " Contract award ").otherwise("").alias("event_category"),
            F.when(day % 4 == 0, "Signed on the day").otherwise("  ").alias("event_description"),
            F.when(day % 8 == 0, "press release").otherwise("").alias("source"),
            F.when(day % 3 == 0, "Unverified").otherwise("").alias("verification_status"),
            F.when(day % 5 == 0, "see file").otherwise("").alias("notes"),
        )
        lost = rows.groupBy("ticker").agg(
            F.lit("1990-01-01").alias("event_date"),
            *[F.max(c).alias(c) for c in rows.columns if c not in ("ticker", "event_date")],
        )
        return rows.unionByName(lost)

    def raw_export(self) -> DataFrame:
        """Bars as a download looks like: other names, text, month-first dates."""
        return self.bars.select(
            "ticker",
            F.date_format("date", "MM/dd/yyyy").alias("Date"),
            F.concat(F.lit("$"), F.format_number("close", 4)).alias("Close/Last"),
            F.format_number("volume", 0).alias("Volume"),
            F.concat(F.lit("$"), F.format_number("open", 4)).alias("Open"),
            F.concat(F.lit("$"), F.format_number("high", 4)).alias("High"),
            F.concat(F.lit("$"), F.format_number("low", 4)).alias("Low"),
        )

    def scratch(self, name: str) -> str:
        return sinks.scratch_path(self.spark, name)


REGISTRY: dict[str, tuple[Callable[[Inputs], DataFrame], int]] = {}


def query(name: str | None = None, digits: int = 8):
    def add(build: Callable[[Inputs], DataFrame]):
        REGISTRY[name or build.__name__] = (build, digits)
        return build

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build, digits):
        return lambda spark, sf_dir: shown(build(Inputs(spark, sf_dir)), digits)

    return {name: bound(build, digits) for name, (build, digits) in REGISTRY.items()}


def columns_of(frame: Callable[[Inputs], DataFrame], *columns: str):
    """Query that shows (ticker, date) and some columns of a frame."""
    return lambda x: frame(x).select("ticker", "date", *columns)


def register_columns(frame: Callable[[Inputs], DataFrame], digits: int, **queries: tuple[str, ...]):
    for name, columns in queries.items():
        REGISTRY[name] = (columns_of(frame, *columns), digits)


def register_taken(digits: int, **queries: tuple[str, ...]):
    """Queries of columns that ``Inputs.taken`` knows."""
    for name, columns in queries.items():
        REGISTRY[name] = (lambda x, wanted=columns: x.taken(*wanted).select("ticker", "date", *wanted), digits)


# ---- sources and sinks ---------------------------------------------------------------


@query()
def read_prices_csv(x: Inputs) -> DataFrame:
    path = x.scratch("bars")
    x.raw_export().write.option("header", True).csv(path)
    return bar_sources.read_prices_csv(x.spark, path)


@query()
def standardize_prices(x: Inputs) -> DataFrame:
    return bar_sources.standardize_prices(x.raw_export())


@query()
def parse_number(x: Inputs) -> DataFrame:
    total = F.col("o_totalprice")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), F.format_number(total, 2)))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), F.format_string("%.2f", total), F.lit(" ")))
        .when(F.col("o_orderkey") % 4 == 2, "n/a")
        .otherwise("")
    )
    orders = derived.table(x.spark, x.sf_dir, "orders")
    return orders.select("o_orderkey", number(text).alias("parsed"))


@query()
def scan_prices(x: Inputs) -> DataFrame:
    path = x.scratch("prices")
    store.write_table(x.price_store, path, ["ticker", "date"], "date", FOLDERS)
    return bar_sources.scan_prices(store.scan_table(x.spark, path, ["AF", "RO"], day="date", buckets=FOLDERS), "AF", "RO")


@query()
def scan_events(x: Inputs) -> DataFrame:
    return bar_sources.scan_events(x.stored, ["AF", "NO"]).select(
        "ticker", "event_date", "trigger_rules", "event_category"
    )


@query()
def scan_fundamentals(x: Inputs) -> DataFrame:
    return bar_sources.scan_fundamentals(x.stored_fundamentals, "NF")


@query()
def scan_stock_profile(x: Inputs) -> DataFrame:
    return bar_sources.scan_stock_profile(x.stored_stocks, "RF")


@query()
def latest_price_update(x: Inputs) -> DataFrame:
    return bar_sources.latest_price_update(x.price_store)


@query()
def prefer_source(x: Inputs) -> DataFrame:
    year = F.year("date")
    chosen = bar_sources.prefer_source(
        [
            ("csv", x.bars.where(F.col("ticker").startswith("A") & (year >= 1998))),
            ("live", x.bars.where(F.col("ticker").startswith("N") & (year >= 1997))),
            ("cache", x.bars),
        ]
    )
    return chosen.select("ticker", "date", "close", "price_source")


@query()
def info_map_scan(x: Inputs) -> DataFrame:
    keys = ("totalRevenue", "sharesOutstanding", "forwardPE", "trailingPE", "ebitda")
    return fundamentals.info_map_scan(x.info, keys)


@query(digits=2)
def statements_unpivot(x: Inputs) -> DataFrame:
    return x.statements


@query()
def earnings_scan(x: Inputs) -> DataFrame:
    return x.releases


def _csv_back(x: Inputs, path: str, schema: T.StructType) -> DataFrame:
    return x.spark.read.schema(schema).option("header", True).csv(path)


@query(digits=6)
def events_sink_csv(x: Inputs) -> DataFrame:
    path = x.scratch("events")
    rows = detection.detection_provenance(x.events.drop("session"))
    sinks.events_sink_csv(rows, path)
    columns = ("ticker", "event_date", "close", "return_zscore", "volume_ratio", "fwd_return_20d",
               "trigger_rules", "event_category", "verification_status")
    return _csv_back(x, path, x.events.drop("session").schema).select(*columns)


@query(digits=4)
def fundamentals_sink_csv(x: Inputs) -> DataFrame:
    path = x.scratch("fundamentals")
    sinks.fundamentals_sink_csv(x.fundamentals, path)
    return _csv_back(x, path, x.fundamentals.schema)


@query(digits=6)
def outcomes_sink_csv(x: Inputs) -> DataFrame:
    path = x.scratch("outcomes")
    pooled = outcomes.pooled_session_outcomes(x.flagged)
    sinks.outcomes_sink_csv(pooled, path)
    return _csv_back(x, path, pooled.schema).select("group", "n_events", "mean_5d", "median_5d", "median_mfe_7d")


@query()
def analysis_json_sink(x: Inputs) -> DataFrame:
    """Documents read back: sections and their sizes."""
    path = x.scratch("analysis")
    documents = sinks.analysis_documents(
        {
            "performance": summaries.performance_windows(x.stats),
            "drawdown": summaries.max_drawdown(x.stats),
            "events": x.events.drop("session"),
            "fundamentals": x.fundamentals,
        }
    )
    sinks.analysis_json_sink(documents, path)
    back = x.spark.read.schema(documents.schema).json(path)
    return back.select(
        "ticker",
        F.size("performance").alias("windows"),
        F.size("events").alias("events"),
        F.size("fundamentals").alias("fundamentals"),
        F.col("drawdown")[0]["trough_date"].alias("trough_date"),
    )


# ---- cleaning ---------------------------------------------------------------------------


@query()
def normalize_ticker(x: Inputs) -> DataFrame:
    parts = derived.table(x.spark, x.sf_dir, "part")
    noisy = parts.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  brk-"), F.col("p_partkey").cast("string"), F.lit(" ")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("^x"), F.col("p_partkey").cast("string")))
        .otherwise(F.col("p_name"))
        .alias("ticker"),
    )
    return cleaning.normalize_ticker(noisy)


@query()
def dedupe_keep_last(x: Inputs) -> DataFrame:
    return cleaning.dedupe_keep_last(x.dirty)


@query()
def drop_bad_close(x: Inputs) -> DataFrame:
    return cleaning.drop_bad_close(x.dirty).select("ticker", "date", "close", "ingest_seq")


@query()
def min_rows_guard(x: Inputs) -> DataFrame:
    # a ticker per order status and year of the bars; only long enough ones stay
    rows = x.bars.withColumn("ticker", F.concat("ticker", F.year("date").cast("string")))
    return cleaning.min_rows_guard(rows, 110).select("ticker", "date", "close")


@query()
def null_negative_volume(x: Inputs) -> DataFrame:
    return cleaning.null_negative_volume(x.dirty).select("ticker", "date", "ingest_seq", "volume")


@query()
def clean_prices(x: Inputs) -> DataFrame:
    return cleaning.clean_prices(x.dirty)


@query()
def quality_report(x: Inputs) -> DataFrame:
    return cleaning.quality_report(x.dirty)


@query()
def long_gaps(x: Inputs) -> DataFrame:
    return cleaning.long_gaps(cleaning.clean_prices(x.dirty))


@query()
def choose_price_column(x: Inputs) -> DataFrame:
    priced = cleaning.choose_price_column(cleaning.clean_prices(x.dirty))
    return priced.select("ticker", "date", "price_column", "price_note", "price")


@query()
def trim_to_period(x: Inputs) -> DataFrame:
    parts = None
    for period in ("1y", "2y", "5y", "10y", "ytd", "max"):
        part = (
            cleaning.trim_to_period(x.bars, period)
            .groupBy("ticker")
            .agg(F.count("*").alias("n"), F.min("date").alias("first_date"))
            .withColumn("period", F.lit(period))
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query()
def stale_tickers(x: Inputs) -> DataFrame:
    return cleaning.stale_tickers(x.bars.where(~((F.col("ticker") == "NO") & (F.year("date") == 2001))), RUN_DATE)


@query()
def short_history_flags(x: Inputs) -> DataFrame:
    first = {"AF": 2001, "AO": 2000, "NF": 1999}
    start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in first.items() for v in p]), F.col("ticker")), F.lit(1995))
    return cleaning.short_history_flags(x.bars.where(F.year("date") >= start))


@query()
def event_filters(x: Inputs) -> DataFrame:
    kept = detection.event_filters(x.found, 2.0, 1.2, ["af", "NO", "RO"])
    return kept.select("ticker", "event_date", "return_zscore", "volume_ratio")


@query(digits=6)
def adjust_ohlcv(x: Inputs) -> DataFrame:
    holes = x.priced.withColumn("high", F.when(F.dayofmonth("date") != 21, F.col("high")))
    return indicators.adjust_ohlcv(holes).select(
        "ticker", "date", "open", "high", "low", "close", "filled_high_low"
    )


# ---- joins -------------------------------------------------------------------------------


@query()
def align_benchmark(x: Inputs) -> DataFrame:
    return relative.align_benchmark(x.bars, x.benchmark, "adj_close").select(
        "ticker", "date", "benchmark_price"
    )


@query(digits=7)
def align_benchmark_indicators(x: Inputs) -> DataFrame:
    return x.taken("benchmark_price", "rel_5d")


@query(digits=7)
def attach_outcomes(x: Inputs) -> DataFrame:
    return x.taken("ema9", "fwd_return_7d", "fwd_abnormal_7d", "mfe_7d")


@query()
def reaction_day(x: Inputs) -> DataFrame:
    calendar = daily_stats.session_number(x.bars)
    return evidence.reaction_day(x.releases, calendar).select(
        "ticker", "release_time", "reaction_date", "reaction_session"
    )


@query()
def earnings_windows(x: Inputs) -> DataFrame:
    calendar = daily_stats.session_number(x.bars)
    return evidence.earnings_windows(x.releases, calendar, 3).select(
        "ticker", "session", "date", "release_time", "offset"
    )


@query()
def match_evidence(x: Inputs) -> DataFrame:
    return x.events.select("ticker", "event_date", *RESEARCH_FIELDS)


@query()
def evidence_coverage(x: Inputs) -> DataFrame:
    return evidence.evidence_coverage(x.releases, x.bars)


@query()
def overlay_research(x: Inputs) -> DataFrame:
    return evidence.overlay_research(x.events, x.stored).select("ticker", "event_date", *RESEARCH_FIELDS)


@query()
def match_import_rows(x: Inputs) -> DataFrame:
    keys = x.edited.select(F.upper("ticker").alias("ticker"), F.to_date("event_date").alias("event_date"))
    return keys.join(x.stored, ["ticker", "event_date"]).select("ticker", "event_date", "event_category")


@query()
def unmatched_keys(x: Inputs) -> DataFrame:
    return merge.unmatched_keys(x.edited, x.stored)


@query()
def refresh_outcomes(x: Inputs) -> DataFrame:
    return merge.refresh_outcomes(x.stored, x.stats, derived.BENCHMARK).select(
        "ticker", "event_date", *OUTCOMES, "refreshed"
    )


@query(digits=4)
def fundamentals_fallback(x: Inputs) -> DataFrame:
    live = x.fundamentals.where(
        ~((F.col("ticker") == "AF") & (F.col("period_type") == "snapshot"))
        & ~((F.col("ticker") == "NO") & (F.col("period_type") == "annual"))
    )
    return fundamentals.fundamentals_fallback(live, x.stored_fundamentals)


@query()
def profile_fallback(x: Inputs) -> DataFrame:
    who = fundamentals.profile(x.info)
    blank = F.col("ticker").startswith("R")
    live = who.select("ticker", *[F.when(~blank, F.col(c)).alias(c) for c in STOCK_FIELDS])
    return fundamentals.profile_fallback(live, x.stored_stocks, STOCK_FIELDS)


@query()
def split_insert_update(x: Inputs) -> DataFrame:
    return merge.split_insert_update(x.stored, x.found)


# ---- per-session statistics -------------------------------------------------------------

register_columns(
    lambda x: x.plain,
    8,
    daily_returns=("daily_return", "log_return"),
    trailing_returns=("return_5d", "return_20d"),
    rolling_baseline=("rolling_mean_return", "rolling_std_return"),
    rolling_volatility=("rolling_volatility",),
    moving_averages=("ma_20", "ma_50"),
    drawdown=("drawdown",),
    forward_returns=tuple(f"fwd_return_{h}d" for h in (1, 2, 3, 5, 7, 20)),
    excursions=tuple(f"{k}_{h}d" for h in (3, 5, 7) for k in ("mfe", "mae")),
    session_number=("session",),
)
register_columns(
    lambda x: x.plain,
    7,
    return_zscore=("return_zscore",),
    volume_baseline=("avg_volume", "volume_std"),
    volume_ratio=("volume_ratio",),
    volume_zscore=("volume_zscore",),
)
register_columns(
    lambda x: x.stats,
    8,
    benchmark_returns=("benchmark_return", "abnormal_return"),
    forward_abnormal=tuple(f"fwd_abnormal_{h}d" for h in (1, 2, 3, 5, 7, 20)),
    relative_performance=("cum_return", "benchmark_cum_return", "relative_performance"),
)


# ---- events -----------------------------------------------------------------------------

LOW_RULES = EventParams(2.0, 1.8, 2.5, 0.03)


@query()
def rule_flags(x: Inputs) -> DataFrame:
    flags = detection.rule_flags(LOW_RULES)
    return x.plain.select("ticker", "date", *[f.alias(r) for r, f in flags.items()])


@query(digits=7)
def detect_events(x: Inputs) -> DataFrame:
    return x.found.select(*EVENT_COLUMNS)


@query()
def anomaly_type(x: Inputs) -> DataFrame:
    found = detection.detect_events(x.plain, LOW_RULES)
    return found.groupBy("ticker", "anomaly_type", "trigger_rules").agg(F.count("*").alias("n"))


@query()
def event_spacing(x: Inputs) -> DataFrame:
    return x.found.select("ticker", "event_date", "session", "trading_days_since_prev_event")


@query()
def direction_counts(x: Inputs) -> DataFrame:
    return detection.direction_counts(x.events)


@query(digits=7)
def recent_events(x: Inputs) -> DataFrame:
    return flows.event_summary(x.events, x.params).select(
        "ticker", "rank", "event_date", "return_zscore", "trigger_rules", "event_category"
    )


@query(digits=7)
def top_n_recent(x: Inputs) -> DataFrame:
    return detection.top_events(x.found, 5, F.desc("event_date")).select(
        "ticker", "rank", "event_date", "daily_return"
    )


@query()
def detection_provenance(x: Inputs) -> DataFrame:
    return detection.detection_provenance(x.found).select("ticker", "event_date", "detection_settings")


@query(digits=7)
def largest_moves(x: Inputs) -> DataFrame:
    return detection.largest_moves(x.found).select("ticker", "rank", "event_date", "return_zscore")


# ---- summaries --------------------------------------------------------------------------


def _summary(name: str, build, digits: int = 8):
    REGISTRY[name] = (build, digits)


_summary("performance_windows", lambda x: summaries.performance_windows(x.plain))
_summary("ytd_return", lambda x: summaries.ytd_return(x.plain))
_summary(
    "full_period_return",
    lambda x: summaries.full_period_return(x.plain).select("ticker", "start_date", "end_date", "trading_days", "full_period_return"),
)
_summary(
    "annualised_return",
    lambda x: summaries.full_period_return(x.plain).select("ticker", "annualised_return"),
)
_summary("range_52w", lambda x: summaries.range_52w(x.plain))
_summary("ma_distance", lambda x: summaries.ma_distance(x.plain))
_summary("return_distribution", lambda x: summaries.return_distribution(x.plain))
_summary("tail_frequency", lambda x: summaries.tail_frequency(x.plain))
_summary("volatility_summary", lambda x: summaries.volatility_summary(x.plain))
_summary("max_drawdown", lambda x: summaries.max_drawdown(x.plain))
_summary("volume_summary", lambda x: summaries.volume_summary(x.plain))
_summary("benchmark_windows", lambda x: summaries.benchmark_windows(x.stats))
_summary("beta_correlation", lambda x: summaries.beta_correlation(x.stats))
_summary("abnormal_volatility", lambda x: summaries.abnormal_volatility(x.stats))
_summary("summarize_statistics", lambda x: summaries.summarize_statistics(x.plain))
_summary("summarize_benchmark", lambda x: summaries.summarize_benchmark(x.stats))
_summary("returns_histogram", lambda x: summaries.returns_histogram(x.plain), 6)


# ---- outcomes ---------------------------------------------------------------------------


@query()
def event_groups(x: Inputs) -> DataFrame:
    return outcomes.event_groups(x.found).select("ticker", "event_date", "group")


@query()
def describe_outcomes(x: Inputs) -> DataFrame:
    """Per ticker and direction, over events without benchmark columns."""
    found = flows.events(x.plain)
    return outcomes.describe_outcomes(found, ["ticker", "direction"], F.count("*"), bounded=True)


@query()
def event_outcomes(x: Inputs) -> DataFrame:
    return flows.event_study(x.bars, x.benchmark, x.params)


@query()
def pooled_event_outcomes(x: Inputs) -> DataFrame:
    return outcomes.pooled_session_outcomes(x.flagged, detection.chosen(min_abs_zscore=1.0, min_volume_ratio=1.0))


@query()
def union_baseline(x: Inputs) -> DataFrame:
    rows = outcomes.event_outcomes(x.found, x.stats)
    return rows.select("ticker", "group", "n_events", "n_20d")


@query()
def pooled_header(x: Inputs) -> DataFrame:
    return outcomes.pooled_header(detection.event_filters(x.found, min_abs_zscore=2.0))


@query()
def avg_forward_by_ticker(x: Inputs) -> DataFrame:
    return outcomes.avg_forward_by_ticker(x.found)


@query()
def reversal_share(x: Inputs) -> DataFrame:
    # lower thresholds, so that there are falls with heavy volume
    return outcomes.reversal_share(flows.events(x.plain, Params(events=EventParams(1.5, 1.5))))


@query(digits=7)
def big_up_moves(x: Inputs) -> DataFrame:
    return detection.big_up_moves(x.found, 1.0, 1.5).select(
        "ticker", "event_date", "daily_return", "return_zscore", "volume_ratio", "fwd_return_5d",
        "fwd_return_20d", "event_category",
    )


@query()
def condition_outcomes(x: Inputs) -> DataFrame:
    conditions = {
        1: (F.lit("Z beyond 1"), F.abs("return_zscore") >= 1.0),
        2: (F.lit("Z beyond 3.5"), F.abs("return_zscore") >= 3.5),
    }
    return outcomes.condition_outcomes(x.stats, conditions)


@query()
def count_episodes(x: Inputs) -> DataFrame:
    masked = x.plain.withColumn("mask", F.col("drawdown") <= -0.05)
    return outcomes.count_episodes(masked, "mask", ["ticker"])


@query()
def historical_context(x: Inputs) -> DataFrame:
    return flows.context_of(x.bars, x.benchmark, x.params)


# ---- indicators ---------------------------------------------------------------------------


@query(digits=6)
def ema(x: Inputs) -> DataFrame:
    spans = {f"ema{n}": ("close", n) for n in indicators.EMA_SPANS}
    return recurrence.ema(x.adjusted, spans).select("ticker", "date", *spans)


@query(digits=6)
def wilder_average(x: Inputs) -> DataFrame:
    """Of the volume, with holes after the seed."""
    holes = x.adjusted.withColumn("v", F.when(F.dayofmonth("date") != 15, F.col("volume")))
    return recurrence.wilder(holes, {"wilder": ("v", 14)}).select("ticker", "date", "wilder")


@query(digits=6)
def sma(x: Inputs) -> DataFrame:
    return x.adjusted.select("ticker", "date", indicators.sma("close", 20).alias("sma20"), indicators.sma("volume", 5).alias("sma5v"))


@query(digits=6)
def rolling_slope(x: Inputs) -> DataFrame:
    df = x.adjusted.withColumn("_pos", F.row_number().over(era_sessions()))
    return df.select("ticker", "date", indicators.rolling_slope("close", 10).alias("slope10"))


@query()
def percentile_of_previous(x: Inputs) -> DataFrame:
    df = x.adjusted.select("ticker", "date", "era", "volume")
    return indicators.percentiles_of_previous(df, {"percentile": ("volume", 252, 126)}).select("ticker", "date", "percentile")


register_taken(
    6,
    ema_slope=("ema9_slope", "ema21_slope", "ema50_slope"),
    rsi=("rsi6", "rsi14"),
    macd=("macd", "macd_signal", "macd_hist"),
    bollinger=("bb_mid", "bb_upper", "bb_lower", "bb_pct_b", "bb_width"),
    band_width_metrics=("bb_width_change", "bb_width_percentile"),
    true_range=("true_range",),
    atr=("atr", "atr_pct", "atr_pct_percentile"),
    realised_vol=("rv20", "rv60"),
    short_returns=tuple(f"ta_return_{n}d" for n in indicators.RETURN_HORIZONS) + ("move_5d_atr",),
    mavol=("mavol20", "ta_volume_ratio", "avg_volume_5d", "volume_5d_vs_mavol20"),
    obv=("obv",),
    obv_slope=("obv_slope10", "obv_slope20"),
    rolling_vwap=("vwap20",),
    adx=("plus_di", "minus_di", "adx"),
    rolling_extremes=("high20", "low20", "high60", "low60", "prior_high20", "prior_low20"),
    relative_returns=("rel_2d", "rel_5d", "rel_7d", "rel_20d", "rel_daily_sigma"),
    compute_indicators=(
        "ema9", "ema200", "rsi6", "macd_hist", "atr", "bb_pct_b", "vwap20", "adx", "obv_slope20",
        "rel_7d", "high60", "prior_low20",
    ),
)


# ---- labels ---------------------------------------------------------------------------------

register_taken(
    6,
    label_trend=("trend",),
    label_ema50=("ema50_state",),
    label_rsi_zone=("rsi_zone",),
    rsi_relationships=("rsi_cross", "rsi_recovering_oversold", "rsi_losing_extended"),
    label_macd=("macd_state",),
    macd_details=("macd_cross", "macd_hist_trend", "macd_zero_context"),
    label_momentum=("momentum",),
    label_volume=("volume_level",),
    day_direction=("day_direction",),
    label_vwap=("vwap_position",),
    label_bb_position=("bb_position",),
    label_band_state=("band_state",),
    label_band_context=("band_context",),
    label_volatility=("volatility",),
    relative_strength_score=("relative_strength_score",),
    label_relative_strength=("relative_strength",),
    label_adx=("adx_state",),
    classify_all=(
        "trend", "rsi_zone", "macd_state", "momentum", "volume_level", "bb_position", "band_state",
        "band_context", "volatility", "relative_strength", "adx_state",
    ),
)
register_taken(
    6,
    swing_condition=(*[f"points_{c}" for c in labels.COMPONENTS], "swing_score", "swing_condition"),
    structure_states=(*[f"is_{k}" for k in STATES], "structure"),
    active_states=("states",),
)


def _gap_query(name: str, build):
    def run(x: Inputs) -> DataFrame:
        gap = recurrence.apart(F.col("ema9"), F.col("ema21"))
        return x.taken("ema9", "ema21", "era").select("ticker", "date", *build(gap))

    REGISTRY[name] = (run, 6)


_gap_query("recent_cross", lambda gap: [labels.recent_cross(gap).alias("ema_cross")])
_gap_query("cross_age", lambda gap: [labels.cross_age(gap).alias("ema_cross_age")])
_gap_query(
    "crossed", lambda gap: [c.alias(n) for c, n in zip(labels.crossed(gap), ("crossed_up", "crossed_down"))]
)


# ---- structure and last session ---------------------------------------------------------------


@query()
def swing_points(x: Inputs) -> DataFrame:
    return structure.swing_points(x.adjusted, 3).select("ticker", "date", "is_swing_high", "is_swing_low")


@query(digits=6)
def level_candidates(x: Inputs) -> DataFrame:
    settings = x.params.technical
    found = structure.level_candidates(_level_frame(x), settings.structure_lookback_days, settings.pivot_bars)
    return found.select("ticker", "price", "origin")


def _level_frame(x: Inputs) -> DataFrame:
    return x.recent(*structure.level_columns(x.params.technical.pivot_bars))


def _levels(x: Inputs) -> DataFrame:
    return flows.levels(_level_frame(x), x.params).withColumn("merged", F.size("also"))


@query(digits=6)
def support_resistance(x: Inputs) -> DataFrame:
    return _levels(x).select(
        "ticker", "side", "level_no", "price", "origin", "distance_pct", "distance_atr", "merged", "also"
    )


@query(digits=6)
def nearest_levels(x: Inputs) -> DataFrame:
    return _levels(x).where(F.col("level_no") == 1).select("ticker", "side", "price", "origin")


@query(digits=6)
def proximity_notes(x: Inputs) -> DataFrame:
    return structure.proximity_notes(x.last(*structure.REFERENCE_COLUMNS)).drop("note")


@query()
def next_earnings(x: Inputs) -> DataFrame:
    """As of the end of 2000; RO has no calendar."""
    last = summaries.last_row(x.old_bars)
    return flows.event_risk(last, x.releases.where(F.col("ticker") != "RO"), x.params)


@query(digits=6)
def technical_analysis(x: Inputs) -> DataFrame:
    """Every ticker's condition with its structure, risk and nearest levels."""
    near = (
        _levels(x)
        .where(F.col("level_no") == 1)
        .groupBy("ticker")
        .agg(
            *[
                F.max(F.when(F.col("side") == s, F.col("price"))).alias(s)
                for s in ("resistance", "support")
            ]
        )
    )
    risk = flows.event_risk(summaries.last_row(x.bars), x.releases, x.params).select("ticker", "status", "sessions_until")
    state = x.last("swing_condition", "swing_score", "structure", "states")
    return state.join(near, "ticker", "left").join(risk, "ticker", "left")


@query(digits=6)
def technical_snapshot(x: Inputs) -> DataFrame:
    return swing.technical_snapshot(x.last(*swing.SNAPSHOT_VALUES, *swing.SNAPSHOT_LABELS, "structure", "states"))


@query(digits=6)
def snapshot_rows(x: Inputs) -> DataFrame:
    return swing.snapshot_rows(x.last(*swing.SNAPSHOT_ROW_COLUMNS))


# the readings of every session, not only the last
register_taken(
    6,
    ema_events=("ema_events",),
    rsi_details=("rsi_details",),
    macd_event_details=("macd_details",),
    obv_divergence=("obv_divergence",),
    rs_shift=("rs_shift",),
    momentum_pace=("momentum_pace",),
    volume_verdict=("volume_verdict",),
)


@query(digits=6)
def atr_ranges(x: Inputs) -> DataFrame:
    return swing.atr_ranges(x.last("close", "atr"))


@query(digits=6)
def reference_levels(x: Inputs) -> DataFrame:
    return structure.reference_levels(x.last(*structure.REFERENCE_COLUMNS))


@query(digits=6)
def chart_window(x: Inputs) -> DataFrame:
    return flows.chart(x.recent(*swing.CHART_SERIES), x.params)


@query(digits=6)
def chart_limits(x: Inputs) -> DataFrame:
    # chart and levels both read the recent sessions, so they are kept as the bars are
    settings = x.params.technical
    frame = x.recent(*swing.AXIS_CORE, *swing.AXIS_CONTEXT, *structure.level_columns(settings.pivot_bars)).persist()
    return swing.chart_limits(swing.recent(frame, settings.chart_days), flows.levels(frame, x.params))


@query()
def technical_notes(x: Inputs) -> DataFrame:
    return flows.technical_notes(x.taken("filled_high_low", "swing_condition"))


# ---- fundamentals ------------------------------------------------------------------------------


@query()
def finite_float(x: Inputs) -> DataFrame:
    pairs = x.info.select("ticker", F.explode("info").alias("key", "text"))
    return pairs.select("ticker", "key", fundamentals.finite_float(F.col("text")).alias("value"))


@query()
def profile(x: Inputs) -> DataFrame:
    return fundamentals.profile(x.info)


@query()
def unit_resolve(x: Inputs) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("money_trading", "money_financial", "per_share", "ratio", "shares"))))
    who = fundamentals.profile(x.info).withColumn("unit_type", kinds)
    return who.select("ticker", "unit_type", fundamentals.unit_resolve(F.col("unit_type")).alias("unit"))


@query(digits=2)
def snapshot_fundamentals(x: Inputs) -> DataFrame:
    return fundamentals.snapshot_fundamentals(x.info, RETRIEVED, PROVIDER)


@query(digits=2)
def annual_fundamentals(x: Inputs) -> DataFrame:
    return x.annual


@query()
def calculated_ratios(x: Inputs) -> DataFrame:
    return fundamentals.calculated_ratios(x.annual, RETRIEVED, PROVIDER)


@query(digits=4)
def annual_table(x: Inputs) -> DataFrame:
    return fundamentals.annual_table(x.fundamentals)


@query(digits=4)
def annual_table_complete(x: Inputs) -> DataFrame:
    return fundamentals.annual_table_complete(x.fundamentals)


@query()
def fundamentals_gaps(x: Inputs) -> DataFrame:
    rows = x.fundamentals.where(
        ~((F.col("ticker") == "AF") & (F.col("period_type") == "snapshot"))
        & ~((F.col("ticker") == "NO") & (F.col("period_type") == "annual"))
    )
    return fundamentals.fundamentals_gaps(x.info, rows)


@query(digits=4)
def metric_labels(x: Inputs) -> DataFrame:
    return fundamentals.metric_labels(x.stored_fundamentals).select(
        "ticker", "period_type", "period_end", "metric", "label", "value"
    )


# ---- merges --------------------------------------------------------------------------------------


@query()
def merge_stocks(x: Inputs) -> DataFrame:
    now = "2002-01-31T00:00:00"
    who = fundamentals.profile(x.info).where(F.col("ticker") != "RO")
    incoming = who.select(
        "ticker",
        *STOCK_FIELDS,
        F.lit(now).alias("first_analyzed"),
        F.lit(now).alias("last_analyzed"),
    )
    return merge.merge_stocks(x.stored_stocks, incoming)


@query()
def merge_prices(x: Inputs) -> DataFrame:
    stored = x.price_store.where(F.year("date") <= 1999)
    incoming = x.price_store.where(F.year("date") >= 1999).withColumns(
        {"close": F.col("close") + 1, "source": F.lit("corrected")}
    )
    path, keys = x.scratch("prices"), ["ticker", "date"]
    store.write_table(stored, path, keys, "date", FOLDERS)
    store.merge_table(x.spark, path, incoming, merge.merge_prices, keys, "date", FOLDERS)
    return store.read_table(x.spark, path).select(*stored.columns)


@query(digits=7)
def merge_events(x: Inputs) -> DataFrame:
    path, keys = x.scratch("events"), ["ticker", "event_date"]
    store.write_table(x.stored, path, keys, "event_date", FOLDERS)
    rule = lambda old, new: merge.merge_events(old, new, (CALENDAR_SOURCE,))
    store.merge_table(x.spark, path, x.events, rule, keys, "event_date", FOLDERS)
    return store.read_table(x.spark, path)


@query(digits=7)
def merge_events_without_benchmark(x: Inputs) -> DataFrame:
    return merge.merge_events(x.stored, flows.events(x.plain), (CALENDAR_SOURCE,)).select(
        "ticker", "event_date", "benchmark", "benchmark_return", "fwd_abnormal_5d", "fwd_return_5d"
    )


@query(digits=4)
def merge_fundamentals(x: Inputs) -> DataFrame:
    path, keys = x.scratch("fundamentals"), ["ticker", "period_type", "period_end", "metric"]
    store.write_table(x.stored_fundamentals, path, keys, buckets=FOLDERS)
    store.merge_table(x.spark, path, x.fundamentals, merge.merge_fundamentals, keys, buckets=FOLDERS)
    return store.read_table(x.spark, path).select(*x.stored_fundamentals.columns)


@query()
def import_research(x: Inputs) -> DataFrame:
    return merge.import_research(x.edited, x.stored).select("ticker", "event_date", *RESEARCH_FIELDS)


@query()
def import_changes(x: Inputs) -> DataFrame:
    return merge.import_changes(x.edited, x.stored)


@query()
def import_counts(x: Inputs) -> DataFrame:
    return merge.import_counts(x.edited, x.stored)


@query()
def evolve_events_schema(x: Inputs) -> DataFrame:
    absent = [c for c in OUTCOMES if c.startswith(("mfe", "mae")) or c[-2:] in ("2d", "3d", "7d")]
    older = x.stored.drop(*absent)
    return merge.evolve_events_schema(older).select("ticker", "event_date", "notes", *OUTCOMES)


@query(digits=7)
def db_values(x: Inputs) -> DataFrame:
    odd = x.plain.withColumn(
        "daily_return",
        F.when(F.col("session") % 10 == 0, F.lit(float("nan")))
        .when(F.col("session") % 10 == 1, F.lit(float("inf")))
        .otherwise(F.col("daily_return")),
    )
    rising = (F.col("log_return") > 0).alias("rising")
    return merge.db_values(odd.select("ticker", "date", "daily_return", rising))


# ---- order, limits, unions ------------------------------------------------------------------------


@query()
def sort_by_date(x: Inputs) -> DataFrame:
    return x.dirty.orderBy("ticker", "date", "ingest_seq").select("ticker", "date", "ingest_seq", "close")


@query()
def last_row_per_ticker(x: Inputs) -> DataFrame:
    return summaries.last_row(x.bars)


@query()
def tail_n(x: Inputs) -> DataFrame:
    return summaries.tail(x.bars, 60).select("ticker", "date", "close")


@query()
def union_frames(x: Inputs) -> DataFrame:
    """Statistics of all tickers are one table already; shown per ticker."""
    return x.plain.groupBy("ticker").agg(
        F.count("daily_return").alias("days"), *[F.count(f"fwd_return_{h}d").alias(f"n_{h}d") for h in (1, 20)]
    )
