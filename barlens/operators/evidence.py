"""Linking events to earnings releases by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import yes
from ..vocab import (
    DATE_MATCHED,
    EARNINGS_CATEGORY,
    MARKET_CLOSE_HOUR,
    RESEARCH_FIELDS,
    UNKNOWN_CATEGORY,
)

RELEASE = ("release_time", "eps_estimate", "reported_eps", "surprise_pct")


def first_possible_day(release_time: str = "release_time") -> Column:
    """Release date, or the next calendar day from the market close on."""
    late = (F.hour(release_time) >= MARKET_CLOSE_HOUR).cast("int")
    return F.date_add(F.to_date(release_time), late)


def reaction_day(releases: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the first session on or after each release's first possible day.

    ``calendar`` is (ticker, date, session).  An as-of join: sessions and the
    DISTINCT days asked for are merged in one sort per ticker (both bounded by the
    calendar), walking backwards so that the running frame sees the next session.
    Releases themselves are then joined on the day; they are never gathered.
    """
    asked = releases.withColumn("_day", first_possible_day())
    days = asked.groupBy("ticker", F.col("_day").alias("date")).agg(
        F.lit(None).cast("long").alias("session")
    )
    both = calendar.select("ticker", "date", "session").unionByName(days)
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.col("session").desc_nulls_last())
    next_session = F.last(
        F.when(F.col("session").isNotNull(), F.struct("date", "session")), ignorenulls=True
    ).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = (
        both.withColumn("_next", next_session)
        .where(F.col("session").isNull())
        .select(
            "ticker",
            F.col("date").alias("_day"),
            F.col("_next.date").alias("reaction_date"),
            F.col("_next.session").alias("reaction_session"),
        )
    )
    return asked.join(found, ["ticker", "_day"], "left").drop("_day")


def earnings_windows(releases: DataFrame, calendar: DataFrame, window_days: int = 1) -> DataFrame:
    """(ticker, date, session, release..., offset): the earliest release owning each session."""
    reacting = reaction_day(releases, calendar).where(F.col("reaction_session").isNotNull())
    first = reacting.groupBy("ticker", "reaction_session").agg(
        F.min(F.struct(*RELEASE)).alias("release")
    )
    offsets = F.explode(F.array(*[F.lit(k).cast("long") for k in range(window_days + 1)]))
    owned = (
        first.withColumn("offset", offsets)
        .groupBy("ticker", (F.col("reaction_session") + F.col("offset")).alias("session"))
        .agg(F.min(F.struct("release", "offset")).alias("_own"))
        .select("ticker", "session", "_own.release.*", "_own.offset")
    )
    return owned.join(calendar.select("ticker", "session", "date"), ["ticker", "session"])


def _known(value: str, pattern: str) -> Column:
    return F.when(F.col(value).isNull(), "not available").otherwise(
        F.format_string(pattern, F.col(value))
    )


def match_evidence(events: DataFrame, windows: DataFrame, source: str) -> DataFrame:
    """Fill the research fields of still unknown events inside a release window."""
    # The wording of the description.
    on_day = "on the first trading session that could react to the release"
    later = " trading day(s) after the first trading session that could react to the release"
    timing = F.when(F.col("offset") == 0, on_day).otherwise(
        F.concat(F.col("offset").cast("string"), F.lit(later))
    )
    description = F.concat(
        F.lit("Earnings release dated "),
        F.date_format("release_time", "yyyy-MM-dd HH:mm"),
        F.lit(" (New York time); this event occurred "),
        timing,
        F.lit(". Reported EPS "),
        _known("reported_eps", "%.2f"),
        F.lit(", EPS estimate "),
        _known("eps_estimate", "%.2f"),
        F.lit(", surprise "),
        _known("surprise_pct", "%.2f%%"),
        F.lit(". Date match only - the cause of the move has not been verified."),
    )
    joined = events.join(
        windows.select("ticker", F.col("date").alias("event_date"), *RELEASE, "offset"),
        ["ticker", "event_date"],
        "left",
    )
    matched = yes(F.col("event_category") == UNKNOWN_CATEGORY) & F.col("release_time").isNotNull()
    filled = {
        "event_category": F.lit(EARNINGS_CATEGORY),
        "event_description": description,
        "source": F.lit(source),
        "verification_status": F.lit(DATE_MATCHED),
    }
    return joined.withColumn("_matched", matched).select(
        *[
            F.when(F.col("_matched"), filled[c]).otherwise(F.col(c)).alias(c) if c in filled else c
            for c in events.columns
        ]
    )


def evidence_coverage(releases: DataFrame, bars: DataFrame) -> DataFrame:
    """Tickers whose calendar begins after their first session."""
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_session"))
    covered = releases.groupBy("ticker").agg(F.min("release_time").alias("covered_from"))
    return first.join(covered, "ticker").where(
        F.col("covered_from") > F.col("first_session").cast("timestamp_ntz")
    )


def overlay_research(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Show the stored research fields (even empty ones) on events that are stored."""
    kept = stored.select(
        "ticker",
        "event_date",
        F.lit(True).alias("_stored"),
        *[F.col(c).alias(f"_s_{c}") for c in RESEARCH_FIELDS],
    )
    joined = events.join(kept, ["ticker", "event_date"], "left")
    return joined.select(
        *[
            F.when(F.col("_stored"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
            if c in RESEARCH_FIELDS
            else c
            for c in events.columns
        ]
    )


def next_earnings(last_sessions: DataFrame, releases: DataFrame | None, window_days: int = 7) -> DataFrame:
    """Per ticker: the next release after its last session, and how near it is.

    Sessions ahead are counted Monday to Friday.  A ticker without any calendar row is
    "unknown", one without a later date is "none".
    """
    base = last_sessions.select("ticker", F.col("date").alias("last_date"))
    if releases is None:
        releases = base.select("ticker", F.lit(None).cast("timestamp_ntz").alias("release_time")).limit(0)
    day = first_possible_day()
    weekend_shift = (
        F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0).cast("int")
    )
    future = (
        releases.select("ticker", "release_time", F.date_add(day, weekend_shift).alias("reaction_date"))
        .join(base, "ticker", "right")
        .groupBy("ticker", "last_date")
        .agg(
            F.count("release_time").alias("_listed"),
            F.min(
                F.when(
                    F.col("reaction_date") > F.col("last_date"),
                    F.struct("reaction_date", "release_time"),
                )
            ).alias("_next"),
        )
    )
    ahead = weekdays_between(F.col("last_date"), F.col("reaction_date"))
    return (
        future.select(
            "ticker",
            "last_date",
            F.when(F.col("_listed") == 0, "unknown")
            .when(F.col("_next").isNull(), "none")
            .otherwise("scheduled")
            .alias("status"),
            "_next.release_time",
            "_next.reaction_date",
        )
        .withColumn("sessions_until", F.when(F.col("status") == "scheduled", ahead))
        .withColumn("within_window", yes(F.col("sessions_until") <= window_days))
    )


def weekdays_between(start: Column, end: Column) -> Column:
    """Monday-to-Friday days in (start, end], in closed form.

    Counts weekdays up to each date from a Monday epoch: five per full week plus
    the weekdays of the last one.
    """

    def count_to(day: Column) -> Column:
        n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long") + 1
        return F.floor(n / 7) * 5 + F.least(F.lit(5).cast("long"), n % 7)

    return (count_to(end) - count_to(start)).cast("long")
